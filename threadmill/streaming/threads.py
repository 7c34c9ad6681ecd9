"""Support threads as a state machine over events, in batch and as a stream.

Events of a thread: ``topic`` (a topic is discovered), ``customer`` and ``support``
(who posted last), ``drafted`` (a follow-up was drafted), ``status`` (a human changed
the status).  exact: the post's date comes from a feed, not from a page or a mail;
promise: the support post promises something; resolved: what a fetched page says, or
null.  The batch fold and the streaming operator share one transition:

                       has_reply  promised_at  waiting_since  last_activity  last_reply
    customer           true       null         null           date           if exact
    topic, new         false      null         null           date           -
    support, promise   false      date         null           -              if exact
    support            false      null         date           -              if exact
    drafted            -          null         null           -              -
    status             false      null         null           -              -

A thread begins with a topic, a customer's post or a support post that is not from a
feed (then last_activity is its date); what comes before that makes no row.  An exact
post that is not newer than the newest exact one is a copy and changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "has_reply boolean, promised_at timestamp, waiting_since timestamp, last_activity timestamp, last_reply timestamp, resolved boolean"
COLUMNS = [c.split()[0] for c in STATE.split(", ")]


def transition(state: tuple | None, kind: str, at, promise: bool, exact: bool, resolved: bool | None) -> tuple | None:
    """The state after an event; None stands for no thread."""
    post = kind in ("customer", "support")
    if state is None:
        if kind not in ("customer", "topic") and not (kind == "support" and not exact):
            return None
        state = (False, None, None, at, None, False)
        if kind == "topic":
            return state
    elif kind == "topic":
        return state
    has_reply, promised, waiting, activity, reply, solved = state
    if post and exact and reply is not None and at <= reply:
        return state
    solved = solved if resolved is None else resolved
    reply = at if post and exact else reply
    if kind == "customer":
        return True, None, None, at, reply, solved
    if kind == "support":
        return False, at if promise else None, None if promise else at, activity, reply, solved
    if kind == "drafted":
        return has_reply, None, None, activity, reply, solved
    return False, None, None, activity, reply, solved


def fold(events: DataFrame) -> DataFrame:
    """The last state of each thread, in one pass without Python.

    events: thread, at, pos, kind, promise, exact, resolved.  Threads without a
    beginning are left out.
    """
    by = Window.partitionBy("thread")
    before = by.orderBy("at", "pos").rowsBetween(Window.unboundedPreceding, -1)
    order = F.struct("at", "pos")
    is_ = lambda *kinds: F.col("kind").isin(*kinds)
    post = is_("customer", "support")
    begins = is_("customer", "topic") | (is_("support") & ~F.col("exact"))
    e = events.withColumn("begin", F.min(F.when(begins, order)).over(by)).where(order >= F.col("begin"))
    newest = F.max(F.when(post & F.col("exact"), F.col("at"))).over(before)
    first = order == F.col("begin")
    live = F.when(is_("topic"), first).otherwise(~(post & F.col("exact")) | newest.isNull() | (F.col("at") > newest))
    e = e.withColumn("live", live).where("live")
    at, none = F.col("at"), F.lit(None).cast("timestamp")
    # max_by passes over nulls, so values travel in a struct.
    last = lambda value, when: F.max_by(F.when(when, F.struct(value.alias("v"))), F.when(when, order))["v"]
    opened = first & is_("topic", "support")
    support = is_("support")
    return e.groupBy("thread").agg(
        last(is_("customer"), ~is_("drafted")).alias("has_reply"),
        last(F.when(support & F.col("promise"), at).otherwise(none), F.lit(True)).alias("promised_at"),
        last(F.when(support & ~F.col("promise"), at).otherwise(none), F.lit(True)).alias("waiting_since"),
        last(at, is_("customer") | opened).alias("last_activity"),
        F.max(F.when(post & F.col("exact"), at)).alias("last_reply"),
        F.coalesce(last(F.col("resolved"), F.col("resolved").isNotNull() & ~is_("topic")), F.lit(False)).alias("resolved"),
    )


def stream(events: DataFrame) -> DataFrame:
    """The state of each thread after every micro-batch that touches it.

    Use with outputMode("update").  Within a batch events are put in order of time
    and position; across batches the newest-reply mark drops what comes late.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = tuple(None if x is None or x is pd.NaT else x for x in state.get) if state.exists else None
        rows = pd.concat(list(batches)).sort_values(["at", "pos"])
        for kind, at, promise, exact, resolved in zip(rows["kind"], rows["at"], rows["promise"], rows["exact"], rows["resolved"]):
            now = transition(now, kind, at.to_pydatetime(), bool(promise), bool(exact), None if pd.isna(resolved) else bool(resolved))
        if now is None:
            return
        state.update(now)
        times = {c: pd.Series([v], dtype="datetime64[us]") for c, v in zip(COLUMNS[1:5], now[1:5])}
        yield pd.DataFrame({"thread": [key[0]], "has_reply": [now[0]]} | times | {"resolved": [now[5]]})

    kind = events.schema["thread"].dataType.simpleString()
    return events.groupBy("thread").applyInPandasWithState(run, f"thread {kind}, {STATE}", STATE, "update", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, time: str, key: str, width: str, late: str) -> DataFrame:
    """Events of each key and window; what is later than the watermark is dropped."""
    return events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))


def upsert_batches(path: str, keys: list[str], version: str, buckets: int = 64):
    """A foreachBatch function that keeps the newest row of each key under path.

    Keys are dealt to buckets by their hash.  A batch rewrites the buckets that it
    touches, in a folder of its own; the newest complete folder that has a bucket is
    that bucket's table, so a batch that is run again changes nothing.  ``_epoch``,
    the number of the batch, may be the version.
    """
    from ..operators.incremental import upsert

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        new = batch.withColumns({"_epoch": F.lit(epoch), "_bucket": F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")})
        touched = [r[0] for r in new.select("_bucket").distinct().collect()]
        old = latest(spark, path, epoch, touched)
        table = upsert(old if old is not None else new.limit(0), new, [*keys, "_bucket"], version)
        table.repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{path}/epoch={epoch:012d}")

    return write


def latest(spark, path: str, before: int, buckets: list[int] | None = None) -> DataFrame | None:
    """Every bucket (or those given) as the newest complete batch before ``before`` left it."""
    Path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    root = Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return None
    newest: dict[int, str] = {}
    for batch in sorted((s.getPath() for s in fs.listStatus(root)), key=lambda p: p.getName()):
        if int(batch.getName().partition("=")[2]) < before and fs.exists(Path(batch, "_SUCCESS")):
            newest |= {int(s.getPath().getName().partition("=")[2]): s.getPath().toString() for s in fs.listStatus(batch) if s.getPath().getName().startswith("_bucket=")}
    parts = [p for b, p in newest.items() if buckets is None or b in buckets]
    return spark.read.option("basePath", path).parquet(*parts).drop("epoch") if parts else None
