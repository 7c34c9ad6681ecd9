"""Which products a text is about: definitions, hits, the primary product."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that every task may hold (some hundred bytes each), and how many white spaces
#: such a word may have.
AUTOMATON_WORDS = 200_000
MOST_GAPS = 4
#: Units of a text that are looked up together.
BLOCK_UNITS = 512
_PLAIN = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ\t\n\x0b\f\r", "abcdefghijklmnopqrstuvwxyz     ")
_WORD = frozenset("abcdefghijklmnopqrstuvwxyz0123456789_")


def definitions(plugins: DataFrame, fallback: DataFrame) -> DataFrame:
    """plugin, name, ord, platform and words of every product: its name, its slug and
    its keywords of two characters or more; the fallback if there is no plugin at
    all.  plugins: plugin, name, slug, keywords, ord, platform; so is fallback."""
    none = plugins.agg((F.count(F.lit(1)) == 0).alias("none"))
    rows = plugins.unionByName(fallback.crossJoin(F.broadcast(none)).where("none").drop("none"))
    words = F.concat(F.array("name"), F.filter(F.concat(F.array("slug"), F.coalesce("keywords", F.array().cast("array<string>"))), lambda w: F.length(F.trim(w)) > 1))
    return rows.select("plugin", "name", "ord", "platform", words.alias("words"))


def patterns(defs: DataFrame) -> DataFrame:
    """def columns without words, and each word with its regular expression."""
    quoted = lambda w: F.regexp_replace(F.trim(w), r"([\\.*+?^${}()|\[\]])", r"\\$1")
    one = lambda w: F.concat(F.lit(r"(?i)(?<![A-Za-z0-9_])"), F.regexp_replace(quoted(w), r"\s+", r"\\s?"), F.lit(r"(?![A-Za-z0-9_])"))
    each = defs.select("plugin", "name", "ord", "platform", F.explode("words").alias("word"))
    return each.withColumn("pattern", one(F.col("word")))


def _units(text: Column) -> Column:
    """Runs of word characters and single other ones, without white space."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[a-z0-9_]+|[^\sa-z0-9_]"), F.lit(0))


def _forms(word: str) -> set[str]:
    """What a word may look like: each inner white space is one or none."""
    parts = [p for p in _low(word).split(" ") if p]
    out = {parts[0]}
    for p in parts[1:]:
        out = {x + gap + p for x in out for gap in ("", " ")}
    return out


def _low(text: str) -> str:
    return text.translate(_PLAIN)


def _scan(words: list[str]):
    """How often each word stands in each text, by one automaton."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[int]] = {}
        for i, w in enumerate(words):
            for form in _forms(w):
                held.setdefault(form, []).append(i)
        automaton = ahocorasick.Automaton()
        for form, owners in held.items():
            automaton.add_word(form, (len(form), owners))
        automaton.make_automaton()
        for batch in batches:
            rows, found, n = [], [], []
            for row, text in enumerate(batch["text"]):
                t = _low(text.as_py() or "")
                count: dict[int, int] = {}
                until: dict[int, int] = {}
                for end, (length, owners) in automaton.iter(t):
                    start = end - length + 1
                    if (start and t[start - 1] in _WORD) or (end + 1 < len(t) and t[end + 1] in _WORD):
                        continue
                    for i in owners:
                        # As a pattern would: from the left, without overlaps.
                        if start >= until.get(i, 0):
                            until[i], count[i] = end + 1, count.get(i, 0) + 1
                rows += [row] * len(count)
                found += [words[i] for i in count]
                n += count.values()
            yield pa.RecordBatch.from_arrays([batch["key"].take(pa.array(rows, pa.int64())), pa.array(found, pa.string()), pa.array(n, pa.int64())], ["key", "word", "n"])

    return run


def _joined(docs: DataFrame, key: str, text: str, words: DataFrame) -> DataFrame:
    """Every run of as many units as words have, without white space, looked up in the
    table of words without white space.  White space in a word may be missing in the
    text, so that a word has as many units, or fewer by what may grow together.  Long
    texts are cut into overlapping blocks."""
    flat = words.select("word", _units(F.col("word")).alias("u"), F.size(F.split(F.trim("word"), r"\s+")).alias("parts"))
    flat = flat.select("word", F.array_join("u", "").alias("flat"), F.size("u").alias("n"), (F.size("u") - F.col("parts") + 1).alias("least"))
    lengths = sorted(r["n"] for r in flat.select(F.explode(F.sequence(F.greatest("least", F.lit(1)), "n")).alias("n")).distinct().collect())
    if not lengths:
        return docs.select(key, F.lit("").alias("word")).where("false")
    rows = docs.select(F.col(key).alias("key"), _units(F.col(text)).alias("u")).where(F.size("u") > 0)
    starts = F.explode(F.sequence(F.lit(1), F.size("u"), F.lit(BLOCK_UNITS)))
    blocks = rows.select("key", "u", starts.alias("at")).select("key", F.slice("u", F.col("at"), F.lit(BLOCK_UNITS + lengths[-1] - 1)).alias("u"))

    def runs(u: Column) -> Column:
        def of(n: int) -> Column:
            last = F.least(F.size(u) - n + 1, F.lit(BLOCK_UNITS))
            return F.when(last > 0, F.transform(F.sequence(F.lit(1), last), lambda i: F.array_join(F.slice(u, i, F.lit(n)), ""))).otherwise(F.array().cast("array<string>"))

        return F.array_distinct(F.concat(*[of(n) for n in lengths]))

    found = blocks.select("key", F.explode(F.transform(F.array("u"), runs)[0]).alias("flat")).join(flat.select("flat", "word"), "flat")
    return found.select(F.col("key").alias(key), "word").distinct()


def hits(docs: DataFrame, key: str, text: str, defs: DataFrame) -> DataFrame:
    """key, name, ord, platform, plugin and hits (one or more) of each product in each
    text; rows with equal keys count together.

    All words are found in one pass over the texts: tasks run an automaton of up to
    AUTOMATON_WORDS words, which are counted before they are sent.  Words of a larger
    table, and those with more than MOST_GAPS white spaces, are joined with the runs of
    words in the texts, and what may hold them is counted by their patterns.
    """
    each = patterns(defs).where(F.size(_units(F.col("word"))) > 0)
    words = each.select("word", (F.size(F.split(F.trim("word"), r"\s+")) <= MOST_GAPS + 1).alias("few")).distinct()
    n = {r["few"]: r["n"] for r in words.groupBy("few").agg(F.count(F.lit(1)).alias("n")).collect()}
    by = ["key", "name", "ord", "platform", "plugin"]
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    parts = []
    scanned = 0 < n.get(True, 0) <= AUTOMATON_WORDS
    if scanned:
        named = [r["word"] for r in words.where("few").collect()]
        found = rows.mapInArrow(_scan(named), f"key {kind}, word string, n bigint").groupBy("key", "word").agg(F.sum("n").alias("n"))
        parts.append(found.join(each, "word").select(*by, "n"))
    rest = words.where("not few") if scanned else words
    if n.get(False, 0) or not scanned:
        found = _joined(rows, "key", "text", rest.select("word")).join(each, "word")
        per = found.groupBy("key").agg(F.collect_list(F.struct("ord", "name", "platform", "plugin", "pattern")).alias("defs"))
        count = lambda d: F.regexp_count(F.col("text"), d["pattern"]).cast("long")
        counted = F.transform("defs", lambda d: F.struct(d["name"].alias("name"), d["ord"].alias("ord"), d["platform"].alias("platform"), d["plugin"].alias("plugin"), count(d).alias("n")))
        parts.append(rows.join(per, "key").select("key", F.inline(counted)).where("n > 0"))
    both = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return both.groupBy(*by).agg(F.sum("n").alias("hits")).select(F.col("key").alias(key), *by[1:], "hits")


def primary(docs: DataFrame, key: str, text: str, tags: str, defs: DataFrame) -> DataFrame:
    """key, product and plugin: what the first tag that names a product names, or else
    the product with the most hits, special ones before platforms; null if none."""
    named = hits(docs.select(F.col(key), F.posexplode_outer(tags).alias("place", "tag")).withColumn("at", F.struct(key, "place")), "at", "tag", defs)
    tagged = named.groupBy(F.col(f"at.{key}").alias(key)).agg(F.min(F.struct(F.col("at.place").alias("place"), "ord", "name", "plugin")).alias("t"))
    said = hits(docs.select(key, text), key, text, defs).groupBy(key).agg(F.min(F.struct("platform", (-F.col("hits")).alias("most"), "ord", "name", "plugin")).alias("h"))
    out = docs.select(key).join(tagged, key, "left").join(said, key, "left")
    return out.select(key, F.coalesce("t.name", "h.name").alias("product"), F.when(F.col("t").isNotNull(), F.col("t.plugin")).otherwise(F.col("h.plugin")).alias("plugin"))


def unnamed_tags(tags: DataFrame, tag: str, n: str, defs: DataFrame, most: int = 20) -> DataFrame:
    """The most frequent tags that name no product: filtered first, then cut."""
    known = hits(tags.select(tag), tag, tag, defs).select(tag).distinct()
    return tags.join(known, tag, "left_anti").orderBy(F.desc(n), tag).limit(most)
