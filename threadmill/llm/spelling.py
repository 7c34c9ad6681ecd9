"""Spelling variants: words that one edit turns into a far more frequent word.

A word is cut into two halves.  One edit leaves one of them whole: the first at the
start of the other word or the second at its end.  Automata of the halves are dealt
out as shards; every word is scanned by the shards that hold halves it could start or
end with, and what is found at the right place in a word of the right length is
compared in full.  Tasks return sums and the best neighbour of each word, never pairs.
"""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import sized, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_CHARS = 7
MIN_COUNT = 2
FACTOR = 10
#: One occurrence in so many has a code point taken out.
ONE_IN = 31
#: Rows (halves and words to scan) of one shard, about, and words that share a half
#: and whose halves are in one shard.
SHARD_ROWS = 100_000
CELL_WORDS = 5_000


def word_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT) -> DataFrame:
    """word and n of every word with min_chars code points and min_count occurrences.

    A word is a maximal run of Latin letters with A-Z lower-cased; where 31 divides
    the CRC-32 of ``<key>:<run>``, the code point at that number modulo the run's
    length is taken out.  Null texts have no words; a null key counts as an empty one.
    """
    found = F.regexp_extract_all(F.col(text), F.lit(rf"[A-Za-zÀ-ÿ]{{{min_chars},}}"), F.lit(0))
    runs = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("doc"), F.explode(found).alias("run"))
    runs = runs.select("doc", F.translate("run", UPPER, LOWER).alias("run"))
    runs = runs.withColumn("h", F.crc32(F.concat("doc", F.lit(":"), "run")))
    at = (F.col("h") % F.char_length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
    words = runs.select(F.when(F.col("h") % ONE_IN == 0, cut).otherwise(F.col("run")).alias("word"))
    counts = words.where(F.char_length("word") >= min_chars).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counts.where(F.col("n") >= min_count)


def one_edit(w: str, v: str) -> bool:
    """Whether one code point put into w, or replaced, gives v; len(v) - len(w) is 0 or 1."""
    i = 0
    while i < len(w) and w[i] == v[i]:
        i += 1
    return w != v and (w[i + 1 :] == v[i + 1 :] if len(w) == len(v) else w[i:] == v[i + 1 :])


def _ends(rest: str, size: int) -> tuple[tuple[int, str], tuple[int, str]]:
    """The first part of a rest, and its last: what halves of rests of length size are."""
    first = size // 2
    return (0, rest[:first]), (1, rest[len(rest) - (size - first) :])


def _scan(table: pa.Table) -> pa.Table:
    """n_near, and n and word of the best neighbour, of each word in one shard.

    The owners of a half are kept by the halves of what is left of them, of which one
    edit leaves one whole as well, so few of them are compared with a word.
    """
    words, counts = table["word"].to_pylist(), table["n"].to_pylist()
    count = dict(zip(words, counts))
    held: dict[str, dict[tuple[int, int], dict[tuple[int, str], list[str]]]] = {}
    for word, side, size, holds in zip(words, table["side"].to_pylist(), table["size"].to_pylist(), table["holds"].to_pylist()):
        if holds:
            cut = size // 2
            half, rest = (word[cut:], word[:cut]) if side else (word[:cut], word[cut:])
            owners = held.setdefault(half, {}).setdefault((side, size), {})
            for end in _ends(rest, len(rest)):
                owners.setdefault(end, []).append(word)
    found: dict[str, list] = {}

    def link(a: str, b: str) -> None:
        mine = found.setdefault(a, [0, 0, ""])
        mine[0] += 1
        if (-count[b], b) < (-mine[1], mine[2]):
            mine[1:] = count[b], b

    automaton = ahocorasick.Automaton()
    for half, owners in held.items():
        automaton.add_word(half, (len(half), owners))
    if held:
        automaton.make_automaton()
    for v in count if held else ():
        for at, (length, owners) in automaton.iter(v):
            for side, here in ((0, at == length - 1), (1, at == len(v) - 1)):
                if not here:
                    continue
                for size in (len(v), len(v) - 1):
                    if (side, size) not in owners:
                        continue
                    cut, rest = size // 2, v[: len(v) - length] if side else v[length:]
                    first, last = _ends(rest, size - length)
                    for end in (first, last):
                        for w in owners[side, size].get(end, ()):
                            # Of two words of a length, of two halves that are whole and of
                            # two ends of a rest, the first counts.
                            if size == len(v) and w >= v or side and w[:cut] == v[:cut]:
                                continue
                            if end is last and _ends(w[:cut] if side else w[cut:], size - length)[0] == first:
                                continue
                            if one_edit(w, v):
                                link(w, v)
                                link(v, w)
    return pa.table({"word": pa.array(list(found), pa.string()), "near": pa.array([x[0] for x in found.values()], pa.int64()), "best_n": pa.array([x[1] for x in found.values()], pa.int64()), "best": pa.array([x[2] for x in found.values()], pa.string())})


def neighbours(words: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """word, n_near, best_n and best of every word (distinct, with n) that has a word
    one edit away; best is the most frequent of them, of equals the first."""
    spark = words.sparkSession
    size = F.char_length("word")
    # As the owner of halves, and as a word to scan for halves of words one shorter.
    both = F.array(*[F.struct(F.lit(side).alias("side"), size.alias("size"), F.lit(True).alias("holds")) for side in (0, 1)])
    longer = F.array(*[F.struct(F.lit(side).alias("side"), (size - 1).alias("size"), F.lit(False).alias("holds")) for side in (0, 1)])
    rows = words.select("word", "n", F.inline(F.when(size > min_chars, F.concat(both, longer)).otherwise(both)))
    half = F.floor(F.col("size") / 2).cast("int")
    rest = F.col("size") - half
    part = F.when(F.col("side") == 0, F.substring("word", F.lit(1), half)).otherwise(F.substring("word", F.char_length("word") - rest + 1, rest))
    rows = rows.withColumn("cell", F.xxhash64("side", "size", part))
    hot = rows.groupBy("cell").agg(F.count_if("holds").alias("words")).where(F.col("words") > CELL_WORDS)
    hot = written(hot.select("cell", F.ceil(F.col("words") / CELL_WORDS).cast("int").alias("pieces")), "spelling-hot")
    if not hot.isEmpty():
        # The halves of a crowded cell are dealt out, and its words meet every piece.
        rows = rows.join(sized(hot), "cell", "left")
        rows = rows.withColumn("piece", F.explode(F.sequence(F.lit(0), F.coalesce("pieces", F.lit(1)) - 1)))
        mine = F.pmod(F.xxhash64("word"), F.coalesce("pieces", F.lit(1))) == F.col("piece")
        rows = rows.withColumn("holds", F.col("holds") & mine).withColumn("cell", F.xxhash64("cell", "piece"))
    n_shards = max(1, -(-4 * words.count() // SHARD_ROWS))
    rows = rows.select(F.pmod("cell", F.lit(n_shards)).alias("shard"), "word", "n", "side", "size", "holds")
    found = rows.groupBy("shard").applyInArrow(_scan, "word string, near bigint, best_n bigint, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("less"), "best"))
    found = found.groupBy("word").agg(F.sum("near").alias("n_near"), best.alias("b"))
    return found.select("word", "n_near", (-F.col("b.less")).alias("best_n"), "b.best")


def spelling_variants(docs: DataFrame, key: str = "doc_id", text: str = "text", factor: int = FACTOR) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of ``word_counts``.

    Two words are near if one code point inserted, deleted or replaced turns one into
    the other.  form: the near word of largest n (of equals the first in the order of
    code points) if that is factor times the word's n or more, else null; root: where
    forms lead to, the word itself if it has none.  Rows that repeat a key and text
    count again.  Null and empty texts have no words; other columns are dropped; an
    empty table gives no words.

    Scale: a word goes to four shards at most.  Only words that share an exact half
    are compared; halves of many words are dealt out over several shards.  Forms are
    at least factor times as frequent, so roots are found in a few joins.
    """
    words = written(word_counts(docs, key, text), "spelling-words")
    out = words.join(neighbours(words), "word", "left")
    has = F.col("best_n") >= factor * F.col("n")
    out = out.select("word", F.when(has, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(has, F.col("best_n")).alias("form_n"))
    out = written(out, "spelling-forms")
    ends = out.where("form is not null").select("word", F.col("form").alias("to"))
    while True:
        # Every word now points twice as far.
        far = ends.select(F.col("word").alias("to"), F.col("to").alias("far"))
        ends = written(ends.join(far, "to", "left").select("word", F.coalesce("far", "to").alias("to"), F.col("far").isNotNull().alias("moved")), "spelling-roots")
        done = ends.where("moved").isEmpty()
        ends = ends.drop("moved")
        if done:
            break
    out = out.join(ends, "word", "left")
    return out.select("word", "form", F.coalesce("to", "word").alias("root"), "n", "n_near", "form_n")
