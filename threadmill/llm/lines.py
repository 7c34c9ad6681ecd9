"""Line dedup: lines that many documents share stay in the first of them only.

Normalised lines are exploded and known by a 128-bit hash; a hash's documents are
counted, and lines of hashes over the threshold go from every document but the
smallest.  What moves is hashes and positions; texts meet the positions of their
lines that go once, at the end, and are put together again in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import sized, written

SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_DOCS = 2
MIN_CHARS = 10


def normalised(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(SPACE)), UPPER, LOWER)


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    """docs with ``kept`` (the lines that stay), ``n_lines`` and ``n_dropped``.

    A line goes if its normalised form has min_chars code points or more and is
    found in min_docs documents or more, of which this one's key is not the
    smallest; that one keeps it as often as it has it.  A null text is an empty
    one, with one empty line.  Rows with equal keys are one document when
    documents are counted, and each loses its own lines; rows with a null key are
    kept whole and are no one's earlier document.  Columns called kept, n_lines or
    n_dropped are replaced, whatever their case; all others stay.  An empty table
    stays empty.

    Scale: a line in very many documents is summed up in every task before its hash
    moves; the join that marks lines has one row on its other side and is split
    by Spark where it is skewed.
    """
    given = [c for c in docs.columns if c.lower() not in ("kept", "n_lines", "n_dropped")]
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.struct(*given).alias("row"), F.col(key).alias("doc"), body.alias("text"), F.xxhash64(body).alias("mark"))
    lines = rows.where("doc is not null").select("doc", "mark", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    lines = lines.withColumn("line", normalised(F.col("line"))).where(F.char_length("line") >= min_chars)
    lines = lines.select("doc", "mark", "at", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"))

    shared = lines.groupBy("h1", "h2").agg(F.count_distinct("doc").alias("n"), F.min("doc").alias("first"))
    shared = sized(written(shared.where(F.col("n") >= min_docs).drop("n"), "shared-lines"))
    # Keys and a hash of the text tell rows apart; rows equal in both have equal lines.
    gone = lines.join(shared, ["h1", "h2"]).where("doc > first").groupBy("doc", "mark").agg(F.collect_set("at").alias("gone"))
    rows = rows.join(gone, ["doc", "mark"], "left")

    # The lines are split once: inside the lambda they have a name.
    def put_together(x: Column) -> Column:
        lines, gone = x["lines"], x["gone"]
        stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
        kept = F.when(gone.isNull(), x["text"]).otherwise(F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n"))
        n_gone = F.coalesce(F.array_size(gone), F.lit(0)).cast("long")
        return F.struct(kept.alias("kept"), F.size(lines).cast("long").alias("n_lines"), n_gone.alias("n_dropped"))

    one = F.array(F.struct("text", F.split("text", "\n").alias("lines"), "gone"))
    return rows.select("row", F.transform(one, put_together)[0].alias("new")).select("row.*", "new.*")
