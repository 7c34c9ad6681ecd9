"""Repetition coverage: how much of a text stands inside repeated n-grams and lines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textbatch import IS_LEAD, Slice, mix, prefix, slices, span_hash

#: Largest share (in hundredths) of a text's word characters that may stand
#: inside n-grams that repeat an earlier one (published web-corpus thresholds).
NGRAM_LIMITS = {5: 15, 6: 14, 7: 13, 8: 12, 9: 11, 10: 10}
#: Largest share of lines, and of word characters in lines, that repeat an earlier line.
LINE_LIMIT, LINE_CHAR_LIMIT = 30, 20
BASE_NGRAM, BASE_WORDS, BASE_SHARE = 8, 20, 30

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True

MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "dup_line_chars", "n_repeat_words", *(f"dup_{n}gram_chars" for n in NGRAM_LIMITS)]


def _repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys occur more than once, and which of those are not the first."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    same = np.zeros(len(k) + 1, bool)
    same[1:-1] = k[1:] == k[:-1]
    repeated, later = np.zeros(len(k), bool), np.zeros(len(k), bool)
    repeated[order] = same[1:] | same[:-1]
    later[order] = same[:-1]
    return repeated, later


def _covered(at: np.ndarray, size: int, n: int) -> np.ndarray:
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, at, 1)
    np.add.at(step, at + size, -1)
    return np.cumsum(step[:-1]) > 0


def measure(s: Slice) -> dict[str, np.ndarray]:
    start, end, text = s.words
    n = s.n
    lead = np.zeros(len(s.data) + 1, np.int64)
    np.cumsum(IS_LEAD[s.data], out=lead[1:])
    chars = lead[end] - lead[start]
    out = {"n_words": np.bincount(text, minlength=n), "word_chars": s.per_text(chars, text), "n_symbols": s.inside(_SYMBOL[s.data])}

    # Lines that hold a word, and whether an equal one stands earlier in the same text.
    breaks = np.flatnonzero(s.data == 10)
    heads = np.unique(np.concatenate([s.offs[:-1], breaks + 1]))
    heads = heads[heads < len(s.data)]
    tails = np.append(heads[1:], len(s.data))
    tails = tails - (s.data[tails - 1] == 10) if len(tails) else tails
    at = np.searchsorted(start, heads), np.searchsorted(start, tails)
    heads, tails, lo, hi = (x[at[1] > at[0]] for x in (heads, tails, *at))
    of = s.text_of(heads)
    wsum = np.zeros(len(chars) + 1, np.int64)
    np.cumsum(chars, out=wsum[1:])
    line_chars = wsum[hi] - wsum[lo]
    key = s.hashes(heads, tails) ^ mix(of + 1)
    order = np.argsort(key, kind="stable")
    later = np.zeros(len(key), bool)
    later[order[1:]] = key[order[1:]] == key[order[:-1]]
    out["n_lines"] = np.bincount(of, minlength=n)
    out["n_dup_lines"] = np.bincount(of[later], minlength=n)
    out["dup_line_chars"] = s.per_text(line_chars[later], of[later])

    # n-grams: a repeated (n+1)-gram begins where a repeated n-gram does, so only
    # the shortest length looks at every position.
    pre = prefix(s.hashes(start, end))
    at = np.arange(len(start))
    for size in sorted(NGRAM_LIMITS):
        at = at[at + size <= len(start)]
        at = at[text[at] == text[at + size - 1]]
        repeated, later = _repeated(span_hash(pre, at, at + size) ^ mix(text[at] + 1))
        covered = _covered(at[later], size, len(start))
        out[f"dup_{size}gram_chars"] = s.per_text(chars[covered], text[covered])
        at = at[repeated]
        if size == BASE_NGRAM:
            out["n_repeat_words"] = np.bincount(text[_covered(at, size, len(start))], minlength=n)
    return out


def repetition_coverage(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with a struct column ``repetition`` of the MEASURES of each whole text.

    Null and empty texts measure 0 everywhere.  Rows are looked at one by one, so
    repeated rows, ties and further columns are left as they are; a column that
    was already called ``repetition`` is replaced.  An empty table stays empty.
    Narrow: no shuffle, texts are compared by 64-bit rolling hashes inside a text.
    """
    schema = "struct<" + ",".join(f"{m}:bigint" for m in MEASURES) + ">"

    @F.pandas_udf(schema)
    def measured(column):
        import pandas as pd

        parts = [measure(s) for s in slices(pa.array(column, pa.large_string(), from_pandas=True))]
        return pd.DataFrame({m: np.concatenate([p[m] for p in parts]) if parts else [] for m in MEASURES})

    return docs.withColumn("repetition", measured(F.col(text)))


def quality_rules(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the measures, ``base_failed`` and ``kept`` as columns; columns of these
    names and one called ``repetition`` are replaced.

    base_failed: fewer than 20 words, or over 30 % of the words in repeated
    8-word windows.  kept: base passed, and no limit of LINE_LIMIT,
    LINE_CHAR_LIMIT and NGRAM_LIMITS exceeded.
    """
    m = repetition_coverage(docs, text)
    r = {x: F.col(f"repetition.{x}") for x in MEASURES}
    failed = (r["n_words"] < BASE_WORDS) | (100 * r["n_repeat_words"] > BASE_SHARE * r["n_words"])
    over = (100 * r["n_dup_lines"] > LINE_LIMIT * r["n_lines"]) | (100 * r["dup_line_chars"] > LINE_CHAR_LIMIT * r["word_chars"])
    for size, limit in NGRAM_LIMITS.items():
        over = over | (100 * r[f"dup_{size}gram_chars"] > limit * r["word_chars"])
    # The struct is computed by one Python node; its fields are then read from it.
    return m.withColumns(r | {"base_failed": failed, "kept": ~failed & ~over}).drop("repetition")
