"""Conversations to retrieval chunks: exchanges, packing, gates and headers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PACK_CHARS = 1600
SPLIT_CHARS = 2400
DOC_CHARS = 1800


def messages(conversations: DataFrame) -> DataFrame:
    """conv, pos, sender (user, operator or note) and text of role-tagged turns."""
    sender = F.when(F.col("role") == "user", "user").when(F.col("role") == "assistant", "operator").otherwise("note")
    return conversations.select(F.col("conv_id").alias("conv"), F.col("turn").alias("pos"), sender.alias("sender"), "text")


def message_line(text: Column) -> Column:
    """What a message adds to a chunk: its trimmed text, or null if that is empty."""
    line = F.regexp_replace(text, r"\A\s+|\s+\z", "")
    return F.when(line != "", line)


def exchange_lines(msgs: DataFrame) -> DataFrame:
    """Lines with the number of the exchange they are in.

    Notes and empty lines are left out.  A customer line after an operator line
    opens an exchange; so does whatever comes first.
    """
    lines = msgs.where(F.col("sender") != "note").withColumn("line", message_line(F.col("text"))).where(F.col("line").isNotNull())
    w = Window.partitionBy("conv").orderBy("pos")
    opens = (F.col("sender") == "user") & (F.lag("sender").over(w) == "operator")
    lines = lines.withColumn("opens", F.coalesce(opens, F.lit(False)).cast("int"))
    return lines.withColumn("exchange", F.sum("opens").over(w)).drop("opens")


def exchanges(msgs: DataFrame) -> DataFrame:
    """conv, exchange, counts of lines by side, first and last position, body."""
    label = F.when(F.col("sender") == "user", "Customer: ").otherwise("Support: ")
    lines = exchange_lines(msgs).withColumn("labelled", F.concat(label, "line"))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "labelled"))), lambda x: x["labelled"]), "\n")
    return lines.groupBy("conv", "exchange").agg(
        F.count_if(F.col("sender") == "user").alias("n_user"),
        F.count_if(F.col("sender") == "operator").alias("n_operator"),
        F.min("pos").alias("first_pos"),
        F.max("pos").alias("last_pos"),
        body.alias("body"),
    )


def pack(df: DataFrame, group: str | list[str], order: str, length: Column, limit: int = PACK_CHARS, gap: int = 2, skip_empty: bool = False) -> DataFrame:
    """group, order and ``chunk``: greedy packing in order.

    A chunk is closed when it holds something and the next piece would take it
    above limit; with skip_empty, empty pieces do not begin one.  Where a piece lands depends on all
    before it, so this is a fold over the lengths of a group's ordered pieces, not a
    window; the lengths of a group travel, its texts do not.
    """

    def fold(sizes: pd.Series) -> pd.Series:
        out = []
        for row in sizes:
            chunk, held, numbers = 0, 0, []
            for n in row:
                if held and held + n > limit:
                    chunk, held = chunk + 1, 0
                numbers.append(chunk)
                held += 0 if skip_empty and not (held or n) else n + gap
            out.append(numbers)
        return pd.Series(out, dtype=object)

    group = [group] if isinstance(group, str) else group
    pieces = df.groupBy(*group).agg(F.sort_array(F.collect_list(F.struct(F.col(order).cast("long").alias("o"), length.cast("long").alias("n")))).alias("pieces"))
    numbers = F.pandas_udf(fold, "array<bigint>")(F.transform("pieces", lambda p: p["n"]))
    packed = pieces.select(*group, F.transform("pieces", lambda p: p["o"]).alias("o"), numbers.alias("chunk"))
    return packed.select(*group, F.inline(F.arrays_zip("o", "chunk"))).withColumnRenamed("o", order)


def joined(order: str, text: str, between: str) -> Column:
    """The texts of a group in order, put together."""
    return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, text))), lambda x: x[text]), between)


def split_long(df: DataFrame, keys: list[str], text: str, limit: int = SPLIT_CHARS) -> DataFrame:
    """keys, piece and text: texts above the limit cut between lines, greedily, and
    lines above it after every ``limit`` characters; others are one piece."""
    long = df.where(F.length(text) > limit).select(*keys, F.posexplode(F.split(text, "\n")).alias("line", "body"))
    cuts = F.sequence(F.lit(0), F.greatest(F.floor((F.length("body") - 1) / limit), F.lit(0)))
    items = long.select(*keys, "line", "body", F.explode(cuts).alias("cut"))
    body = F.col("body").substr(F.col("cut").cast("int") * limit + 1, F.lit(limit))
    items = items.select(*keys, (F.col("line").cast("long") * (1 << 32) + F.col("cut")).alias("item"), body.alias(text), (F.length("body") > limit).alias("hard"))
    # A part of a cut line fills a piece, whatever is left for it.
    size = F.when(F.col("hard"), limit).otherwise(F.length(text))
    placed = items.join(pack(items, keys, "item", size, limit, 1, True), [*keys, "item"])
    pieces = placed.groupBy(*keys, F.col("chunk").alias("piece")).agg(F.regexp_replace(joined("item", text, "\n"), r"\A\n+", "").alias(text))
    whole = df.where(F.length(text) <= limit).select(*keys, F.lit(0).cast("long").alias("piece"), text)
    return whole.unionByName(pieces.where(F.col(text) != ""))


def chunks(msgs: DataFrame) -> DataFrame:
    """conv, chunk, exchanges (or pieces of long ones) in it, its body and length."""
    ex = split_long(exchanges(msgs).select("conv", "exchange", "body"), ["conv", "exchange"], "body")
    ex = ex.select("conv", (F.col("exchange") * (1 << 32) + F.col("piece")).alias("exchange"), "body")
    placed = ex.join(pack(ex, "conv", "exchange", F.length("body")), ["conv", "exchange"])
    return placed.groupBy("conv", "chunk").agg(F.count(F.lit(1)).alias("n_exchanges"), joined("exchange", "body", "\n\n").alias("body")).withColumn("n_chars", F.length("body"))


#: Commit notices of a code repository that were forwarded as mail (fixed value).
NOISE = r"\A\s*[*_]*\s*\[WordPress Plugin\]"


def chunkable(msgs: DataFrame, noise: str = NOISE) -> DataFrame:
    """Conversations with a customer line and a support line whose first customer
    line is not mere noise."""
    g = msgs.groupBy("conv").agg(
        F.bool_or(F.col("sender") == "user").alias("user"),
        F.bool_or(F.col("sender") == "operator").alias("operator"),
        F.min_by(F.when(F.col("sender") == "user", F.coalesce("text", F.lit(""))), F.when(F.col("sender") == "user", F.col("pos"))).alias("first"),
    )
    return g.where(F.col("user") & F.col("operator") & ~F.col("first").rlike(noise)).select("conv")


def first_customer_line(msgs: DataFrame, n: int = 120) -> DataFrame:
    """The topic of a conversation: its first customer line that is no attachment."""
    lines = msgs.where(F.col("sender") == "user").withColumn("line", message_line(F.col("text"))).where(~F.col("line").startswith("[attachment"))
    return lines.groupBy("conv").agg(F.substring(F.min_by("line", "pos"), 1, n).alias("topic"))


def chunk_header(session: Column, date: Column, product: Column, tags: Column, language: Column) -> Column:
    """[Session: ... | Date: ... | ...] without what is missing."""
    part = lambda name, value: F.when(value.isNotNull() & (value != ""), F.concat(F.lit(f"{name}: "), value))
    return F.concat(F.lit("["), F.concat_ws(" | ", part("Session", session), part("Date", date), part("Product", product), part("Tags", tags), part("Language", language)), F.lit("]"))


def split_paragraphs(docs: DataFrame, key: str, text: str, limit: int = DOC_CHARS) -> DataFrame:
    """key, chunk (0, 1, ...) and body: whole paragraphs packed greedily, and pieces of
    limit characters of each paragraph above it, which stand alone.  Bodies are
    trimmed; of paragraphs, those with nothing left are no chunk."""
    trimmed = lambda c: F.regexp_replace(c, r"\A[\s\p{Z}\x{FEFF}]+|[\s\p{Z}\x{FEFF}]+\z", "")
    rows = docs.select(key, F.posexplode(F.split(text, r"\n{2,}")).alias("p", "body")).withColumn("long", F.length("body") > limit)
    # Paragraphs between two long ones are packed on their own.
    rows = rows.withColumn("run", F.count_if("long").over(Window.partitionBy(key).orderBy("p")))
    whole = rows.where("not long")
    placed = whole.join(pack(whole.select(key, "run", "p", "body"), [key, "run"], "p", F.length("body"), limit, skip_empty=True), [key, "run", "p"])
    packed = placed.groupBy(key, "run", F.col("chunk").alias("i")).agg(trimmed(joined("p", "body", "\n\n")).alias("body")).where("body <> ''")
    cuts = F.sequence(F.lit(0), F.floor((F.length("body") - 1) / limit))
    pieces = rows.where("long").select(key, "run", F.explode(cuts).alias("i"), "body")
    pieces = pieces.select(key, "run", "i", trimmed(F.col("body").substr(F.col("i").cast("int") * limit + 1, F.lit(limit))).alias("body"))
    both = packed.withColumn("after", F.lit(True)).unionByName(pieces.withColumn("after", F.lit(False)))
    number = F.row_number().over(Window.partitionBy(key).orderBy("run", "after", "i")) - 1
    return both.select(key, number.alias("chunk"), "body")
