"""The state machine: its table, batch, stream and a plain fold agree."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from threadmill.streaming import threads as S

SCHEMA = "thread int, at timestamp, pos long, kind string, promise boolean, exact boolean, resolved boolean"
OLD, NOW = dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2)
BUSY = (True, OLD, OLD, OLD, OLD, False)

#: state, event, state after it
TABLE = [
    (BUSY, ("customer", NOW, False, True, True), (True, None, None, NOW, NOW, True)),
    (BUSY, ("customer", NOW, False, False, None), (True, None, None, NOW, OLD, False)),
    (None, ("customer", NOW, False, True, None), (True, None, None, NOW, NOW, False)),
    (None, ("topic", NOW, False, True, None), (False, None, None, NOW, None, False)),
    (BUSY, ("topic", NOW, False, True, None), BUSY),
    (BUSY, ("support", NOW, True, True, None), (False, NOW, None, OLD, NOW, False)),
    (BUSY, ("support", NOW, False, True, None), (False, None, NOW, OLD, NOW, False)),
    (BUSY, ("support", NOW, False, False, None), (False, None, NOW, OLD, OLD, False)),
    (None, ("support", NOW, False, True, None), None),
    (None, ("support", NOW, True, False, None), (False, NOW, None, NOW, None, False)),
    (None, ("support", NOW, False, False, True), (False, None, NOW, NOW, None, True)),
    (BUSY, ("drafted", NOW, False, False, None), (True, None, None, OLD, OLD, False)),
    (BUSY, ("status", NOW, False, False, None), (False, None, None, OLD, OLD, False)),
    (None, ("status", NOW, False, False, None), None),
    (BUSY, ("customer", OLD, False, True, True), BUSY),
]


@pytest.mark.parametrize("before,event,after", TABLE)
def test_transitions(before, event, after):
    assert S.transition(before, *event) == after


def events(n=500):
    r = random.Random(5)
    kinds = ["topic", "customer", "support", "support", "drafted", "status"]
    return [(r.randrange(14), OLD + dt.timedelta(minutes=r.randrange(300)), i, r.choice(kinds), r.random() < 0.4, r.random() < 0.7, r.choice([None, True, False])) for i in range(n)]


def expected(rows):
    out = {}
    for t, at, _, *rest in sorted(rows, key=lambda e: (e[1], e[2])):
        out[t] = S.transition(out.get(t), rest[0], at, *rest[1:])
    return {t: s for t, s in out.items() if s is not None}


def as_dict(df):
    return {r["thread"]: tuple(r[c] for c in S.COLUMNS) for r in df.collect()}


def test_batch_fold(spark):
    rows = events() + [(99, NOW, 1, "status", False, True, None), (98, NOW, 1, "support", False, True, None)]
    assert as_dict(S.fold(spark.createDataFrame(rows, SCHEMA))) == expected(rows)
    assert S.fold(spark.createDataFrame([], SCHEMA)).count() == 0


def test_stream_equals_batch(spark, tmp_path):
    rows = sorted(events(), key=lambda e: (e[1], e[2]))
    for i in range(5):
        spark.createDataFrame(rows[i * 100 : (i + 1) * 100], SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    q = S.stream(source).writeStream.outputMode("update").foreachBatch(S.upsert_batches(f"{tmp_path}/out", ["thread"], "_epoch", 5)).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert as_dict(S.latest(spark, f"{tmp_path}/out", 1 << 40)) == expected(rows)


def test_a_batch_rewrites_what_it_touches(spark, tmp_path):
    write = S.upsert_batches(f"{tmp_path}/t", ["k"], "_epoch", 4)
    rows = lambda *pairs: spark.createDataFrame(pairs, "k int, v int")
    write(rows(*[(k, 0) for k in range(20)]), 1)
    write(rows((3, 5)), 2)
    write(rows((3, 5)), 2)
    got = {r["k"]: r["v"] for r in S.latest(spark, f"{tmp_path}/t", 9).collect()}
    assert got == {k: 5 if k == 3 else 0 for k in range(20)}
    assert spark.read.parquet(f"{tmp_path}/t/epoch=000000000002").select("_bucket").distinct().count() == 1


def test_windowed_counts(spark, tmp_path):
    spark.createDataFrame(events(50), SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
    q = S.windowed_counts(source, "at", "thread", "1 hour", "10 minutes").writeStream.outputMode("complete").format("memory").queryName("wc").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.sql("select sum(n) as n from wc").first()["n"] == 50
