"""Timers: what falls due without an event, across restarts."""

import datetime as dt
import random

import pytest

from threadmill.streaming import digest as D

SCHEMA = "desk string, thread string, at timestamp, waiting_since timestamp, promised_at timestamp"
START = dt.datetime(2024, 1, 1)
H = lambda n: START + dt.timedelta(hours=n)


def test_what_is_due():
    h = D.HOUR
    assert D.due({}, {}, None, 5 * h, 3 * h, h) == ([], [], None)
    assert D.due({"b": 0, "a": 0, "c": 2 * h}, {}, None, 4 * h, 3 * h, h) == (["a", "b"], [], 4 * h + D.GAP)
    assert D.due({"a": 0}, {}, 2 * h, 4 * h, 3 * h, h) == ([], [], 2 * h + D.GAP)
    assert D.due({"a": 3 * h}, {"p": 0, "q": 4 * h}, 0, 4 * h, 3 * h, h) == ([], [(h, "p")], 5 * h)


def brute(runs, silence, patience):
    """Hour after hour.  A batch is followed by the hours up to the newest time of those
    before it, the last one of a run by those up to its own."""
    out, desks, clock, newest = [], {}, 0, 0
    for run_ in runs:
        for batch in [*run_, []]:
            for desk, thread, at, waiting, promised in sorted(batch, key=lambda r: r[2]):
                d = desks.setdefault(desk, [{}, {}, None])
                for held, when in ((d[0], waiting), (d[1], promised)):
                    held.pop(thread, None)
                    if thread is not None and when is not None:
                        held[thread] = when
            for n in range(clock + 1, newest + 1):
                for desk, (waits, promises, sent) in desks.items():
                    for t, at in sorted(promises.items()):
                        if at + patience == H(n):
                            out.append((desk, "promise", H(n), t, None))
                            promises.pop(t)
                    silent = [t for t, at in waits.items() if at + silence <= H(n)]
                    if silent and (sent is None or H(n) - sent >= dt.timedelta(hours=22)):
                        out.append((desk, "digest", H(n), None, len(silent)))
                        desks[desk][2] = H(n)
            clock = newest
            newest = max([newest] + [(r[2] - START) // dt.timedelta(hours=1) for r in batch])
    return sorted(out, key=str)


@pytest.fixture()
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.unset(name)
    spark.conf.set("spark.sql.shuffle.partitions", old)


def run(spark, where, silence, patience):
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{where}/in")
    out = D.reminders(source, silence, patience)
    q = out.writeStream.outputMode("append").format("parquet").option("path", f"{where}/out").option("checkpointLocation", f"{where}/cp").trigger(availableNow=True).start()
    q.awaitTermination(300)
    assert q.exception() is None


def test_stream_sends_once_and_survives_a_restart(spark, tmp_path, rocks):
    r = random.Random(4)
    batches = []
    for i in range(6):
        rows = [("tick", None, H(20 * i + 19), None, None)]
        for _ in range(6):
            at = H(20 * i + r.randrange(20))
            kind = r.random()
            rows.append((f"d{r.randrange(2)}", f"t{r.randrange(5)}", at, at if kind < 0.5 else None, at if 0.5 <= kind < 0.8 else None))
        batches.append(rows)
    batches[3] = [("tick", None, H(79), None, None)]  # time passes, nothing else
    batches.append([("tick", None, H(400), None, None)])
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
        if i in (2, len(batches) - 1):
            run(spark, tmp_path, 10, 30)
    got = sorted(((x["desk"], x["kind"], x["at"], x["thread"], x["total"]) for x in spark.read.parquet(f"{tmp_path}/out").collect()), key=str)
    want = brute([batches[:3], batches[3:]], dt.timedelta(hours=10), dt.timedelta(hours=30))
    assert got == want and {g[1] for g in got} == {"digest", "promise"}


def test_a_desk_without_silent_threads_sends_nothing(spark, tmp_path, rocks):
    batches = [[("d", "t", H(0), H(0), None)], [("d", "t", H(5), None, None), ("d", "u", H(6), H(6), None)], [("d", None, H(15), None, None)], [("d", None, H(17), None, None)]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    run(spark, tmp_path, 10, 30)
    got = [(x["kind"], x["at"], x["threads"]) for x in spark.read.parquet(f"{tmp_path}/out").collect()]
    assert got == [("digest", H(16), ["u"])]
