"""Web archives: writing WARC records and reading them back with checked boundaries.

Records are written by Spark's own text writer, one record to a line whose
separator is the two line breaks that end a WARC record, so any file system that
Spark reaches will do.  Archives are read back in splits.  A task cannot know
whether a version line that it meets begins a record or stands inside a payload,
so it only emits a candidate: an offset, and the offset at which the record's own
length says that the next one begins.  Pointer jumping from the start of each
file then keeps the candidates that can be reached.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import new_path, written

VERSION = "WARC/1.1\r\n"
END = "\r\n\r\n"
MIN_REVISIT = 1000
#: Rows with a table of revisits up to this many are written without moving payloads.
BROADCAST_ROWS = 500_000
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def classify(pages: DataFrame, page_id: str = "page_id", payload: str = "html", min_bytes: int = MIN_REVISIT) -> DataFrame:
    """page_id, digest and refers_to of the rows that revisit another one.

    Of the rows whose payloads are equal and have min_bytes at least, the one
    with the largest page_id is the response and the others revisit it.  Rows that
    share that largest page_id are all responses; a null page_id counts as the
    smallest.  A null payload is an empty one.
    """
    body = F.coalesce(F.col(payload), F.lit("")).cast("binary")
    sums = pages.select(F.col(page_id).alias("page_id"), F.sha1(body).alias("digest"), F.octet_length(body).alias("size"))
    sums = written(sums.where(F.col("size") >= min_bytes).select("page_id", "digest"), "warc-digests")
    # One row for each repeated payload; partial sums keep a hot payload from one task.
    groups = sums.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    later = sums.join(groups, "digest").where(~F.col("page_id").eqNullSafe(F.col("refers_to")) & F.col("refers_to").isNotNull())
    return later.distinct()


def write_warc(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = MIN_REVISIT, date: str = "2024-01-01T00:00:00Z") -> None:
    """One record for each row of pages: a response with the payload, or a revisit.

    Headers keep the length and SHA-1 of the full payload.  Line breaks in a URL
    are percent-encoded; a null URL or page_id leaves its header out.  Payloads
    are not moved between tasks unless the table of revisits is too large to
    broadcast (its rows are counted first).
    """
    revisits = written(classify(pages, page_id, payload, min_bytes), "warc-revisits")
    small = revisits.count() <= BROADCAST_ROWS
    body = F.coalesce(F.col(payload), F.lit("")).cast("binary")
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), body.alias("body"), F.sha1(body).alias("digest"))
    revisits = revisits.select(F.col("page_id").alias("r_id"), F.col("digest").alias("r_digest"), "refers_to")
    revisits = F.broadcast(revisits) if small else revisits.hint("merge")
    rows = rows.join(revisits, F.col("page_id").eqNullSafe(F.col("r_id")) & (F.col("digest") == F.col("r_digest")), "left")
    again = F.col("refers_to").isNotNull()

    def header(name: str, value: Column) -> Column:
        return F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n")), F.lit(""))

    safe_url = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    size = F.octet_length("body")
    head = F.concat(
        F.lit(VERSION),
        header("WARC-Type", F.when(again, "revisit").otherwise("response")),
        header("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.col("page_id").cast("string"), F.lit(">"))),
        header("WARC-Date", F.lit(date)),
        header("WARC-Target-URI", safe_url),
        header("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))),
        header("WARC-Profile", F.when(again, _PROFILE)),
        header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        header("X-Payload-Length", size),
        header("Content-Type", F.lit("text/html; charset=utf-8")),
        header("Content-Length", F.when(again, 0).otherwise(size)),
        F.lit("\r\n"),
    )
    # Bytes pass through a string column unchanged; the writer adds the separator.
    record = F.concat(head.cast("binary"), F.when(again, F.lit(b"")).otherwise(F.col("body"))).cast("string")
    rows.select(record.alias("value")).write.option("lineSep", END).text(path)


def _pieces(spark, path: str) -> DataFrame:
    """The archives cut at every version line that follows a record's end.

    head: the piece is the first of its file (and holds the first version line).
    Pieces of a split are in file order by ``at``; a split's place is known by
    its file and first byte.
    """
    lines = spark.read.option("lineSep", END + VERSION).text(path)
    return lines.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("at"),
        F.col("value").cast("binary").alias("piece"),
    )


def _candidate(piece: Column) -> dict[str, Column]:
    """What a piece says of the record that it may begin."""
    text = piece.cast("string")
    head = F.concat(F.lit("\r\n"), F.substring_index(text, END, 1), F.lit("\r\n"))

    def value(name: str, kind: str = "([^\r\n]*)") -> Column:
        found = F.regexp_extract(head, rf"\r\n{name}: {kind}\r\n", 1)
        return F.when(found != "", found)

    return {
        "head_bytes": F.octet_length(F.substring_index(text, END, 1)) + len(END),
        "body_bytes": value("Content-Length", "([0-9]{1,18})").cast("long"),
        "record_type": value("WARC-Type"),
        "page_id": value("WARC-Record-ID", "<urn:page:(-?[0-9]{1,19})>"),
        "refers_to": value("WARC-Refers-To", "<urn:page:(-?[0-9]{1,19})>"),
        "url": value("WARC-Target-URI"),
        "digest": value("WARC-Payload-Digest", "sha1:([0-9a-f]{40})"),
        "payload_bytes": value("X-Payload-Length", "([0-9]{1,18})").cast("long"),
    }


def read_warc(spark, path: str) -> DataFrame:
    """file, offset, page_id, url, record_type, refers_to, payload_bytes, payload_digest
    and ``intact`` of every record of the archives under path.

    Version lines inside payloads are rejected: only records that are reached
    from the start of their file by record lengths are kept, in about log2 of the
    records of a file rounds of pointer jumping.  intact: the payload has the
    length and SHA-1 that its header says (a revisit has none and is intact).
    A file that does not begin with a version line gives no record; an archive
    that breaks off keeps the records before the break.  Payloads themselves are
    moved between tasks only where a payload holds a version line.
    """
    pieces = _pieces(spark, path)
    size = F.octet_length("piece")
    c = _candidate(F.when(F.col("first"), F.expr(f"substring(piece, {len(VERSION) + 1})")).otherwise(F.col("piece")))
    first = (F.col("split") == 0) & (F.substring(F.col("piece"), 1, len(VERSION)) == F.lit(VERSION.encode()))
    found = pieces.withColumn("first", first).select("file", "split", "at", size.alias("size"), "piece", "first", *[v.alias(k) for k, v in c.items()])
    skip = F.when(F.col("first"), len(VERSION)).otherwise(0)
    start = skip + F.col("head_bytes") + 1
    whole = F.col("body_bytes") <= F.col("size") - start + 1
    body = F.substring(F.col("piece"), start.cast("int"), F.col("body_bytes").cast("int"))
    found = found.withColumns({"whole": F.coalesce(whole, F.lit(False)), "sha1": F.when(whole, F.sha1(body))}).drop("piece")
    # Only numbers and header fields are written; the payloads stay in the archives.
    found = written(found, "warc-candidates")

    # Where each piece begins: sums over the splits of a file, then inside a split.
    gap = len(END) + len(VERSION)
    per_split = found.groupBy("file", "split").agg(F.sum(F.col("size") + gap).alias("bytes"))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    per_split = per_split.select("file", "split", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("base"))
    inner = Window.partitionBy("file", "split").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    placed = found.withColumn("inner", F.coalesce(F.sum(F.col("size") + gap).over(inner), F.lit(0))).join(per_split, ["file", "split"])
    # A record begins at its version line, which the separator of the piece before holds.
    begin = F.col("base") + F.col("inner")
    offset = F.when(begin == 0, 0).otherwise(begin - len(VERSION))
    length = len(VERSION) + F.col("head_bytes") + F.col("body_bytes") + len(END)
    known = F.col("body_bytes").isNotNull() & ((begin > 0) | F.col("first"))
    placed = written(placed.withColumn("offset", offset).withColumn("next", F.when(known, offset + length)), "warc-placed")

    reached = _reachable(placed.where(F.col("next").isNotNull()).select("file", "offset", "next"))
    good = placed.join(reached, ["file", "offset"])
    meta = ["file", "offset", "page_id", "url", "record_type", "refers_to", "payload_bytes", "digest", "body_bytes"]
    simple = good.where("whole").select(*meta, "sha1")
    broken = good.where(~F.col("whole")).select(*meta)
    records = simple
    if not broken.isEmpty():
        # A payload that holds version lines: put its pieces together again.
        mark = reached.withColumn("reached", F.lit(True))
        so_far = Window.partitionBy("file").orderBy("offset")
        owner = F.last(F.when(F.col("reached"), F.col("offset")), ignorenulls=True).over(so_far)
        near = placed.select("file", "split", "at", "offset").join(mark, ["file", "offset"], "left").withColumn("owner", owner)
        near = near.select("file", "split", "at", F.col("offset").alias("piece_offset"), F.col("owner").alias("offset"))
        near = near.join(broken, ["file", "offset"])
        parts = near.join(pieces.select("file", "split", "at", "piece"), ["file", "split", "at"])
        parts = parts.groupBy(*meta).agg(F.sort_array(F.collect_list(F.struct("piece_offset", "piece"))).alias("parts"))
        joined = F.expr(f"aggregate(slice(parts, 2, size(parts)), parts[0].piece, (a, p) -> concat(a, cast('{END}{VERSION}' as binary), p.piece))".replace("\r", "\\r").replace("\n", "\\n"))
        whole_text = F.when(F.col("offset") == 0, F.expr(f"substring(joined, {len(VERSION) + 1})")).otherwise(F.col("joined"))
        parts = parts.withColumn("joined", joined).withColumn("joined", whole_text)
        from_ = F.octet_length(F.substring_index(F.col("joined").cast("string"), END, 1)) + len(END) + 1
        body = F.substring(F.col("joined"), from_.cast("int"), F.col("body_bytes").cast("int"))
        parts = parts.withColumn("sha1", F.when(F.octet_length(body) == F.col("body_bytes"), F.sha1(body)))
        records = simple.unionByName(parts.select(*meta, "sha1"))
    intact = F.when(F.col("record_type") == "revisit", F.col("body_bytes") == 0).otherwise((F.col("sha1") == F.col("digest")) & (F.col("payload_bytes") == F.col("body_bytes")))
    return records.select(
        "file",
        "offset",
        F.col("page_id").try_cast("long").alias("page_id"),
        "url",
        "record_type",
        F.col("refers_to").try_cast("long").alias("refers_to"),
        "payload_bytes",
        F.when(F.col("record_type") == "revisit", F.col("digest")).otherwise(F.col("sha1")).alias("payload_digest"),
        F.coalesce(intact, F.lit(False)).alias("intact"),
    )


def _reachable(links: DataFrame) -> DataFrame:
    """file and offset of the links that are reached from offset 0 of their file.

    Round k knows the records less than 2**k steps away and each link's target
    2**k steps on; joining the two doubles the distance.
    """
    reached = links.where("offset = 0").select("file", "offset")
    jump = links
    n = reached.count()
    while n:
        step = reached.join(jump, ["file", "offset"]).select("file", F.col("next").alias("offset"))
        step = step.join(links.select("file", "offset"), ["file", "offset"], "left_semi")
        grown = written(reached.unionByName(step).distinct(), "warc-reached")
        more = grown.count()
        if more == n:
            return reached
        reached, n = grown, more
        far = jump.select("file", F.col("offset").alias("next"), F.col("next").alias("far"))
        jump = jump.join(far, ["file", "next"]).select("file", "offset", F.col("far").alias("next"))
        jump = written(jump, "warc-jumps")
    return reached


def round_trip(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Writes pages as archives (to a new shared folder unless a path is given) and reads them back."""
    spark = pages.sparkSession
    path = path or new_path(spark, "warc")
    write_warc(pages, path)
    return read_warc(spark, path)
