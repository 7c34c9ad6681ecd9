"""Vectors for chunks: those that are known are used again, others come from a model.

A model is any function from some texts to as many vectors.  It is called by tasks, in
batches; the default needs no network and hashes words.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.desk import valid_vector
from ..tables import written
from .incremental import reuse_embeddings

BATCH = 64
Model = Callable[[list[str]], list[list[float]]]


def hashing_model(dims: int) -> Model:
    """Words and pairs of neighbours, each added to or taken from the component that its
    CRC-32 names, and the whole brought to length 1; a text without words gives the
    first unit vector."""

    def run(texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), dims))
        for i, text in enumerate(texts):
            words = re.findall(r"[^\W_]+", text.lower())
            for feature in words + [f"{a} {b}" for a, b in zip(words, words[1:])]:
                h = zlib.crc32(feature.encode())
                out[i, (h >> 1) % dims] += 1 if h & 1 else -1
            if not out[i].any():
                out[i, 0] = 1
        return (out / np.linalg.norm(out, axis=1, keepdims=True)).tolist()

    return run


def embed(rows: DataFrame, key: str, text: str, model: Model, dims: int, batch: int = BATCH) -> DataFrame:
    """key, vector and error of every row: one of the last two is null.

    A blank or null text goes to the model as one space.  Where a batch fails its texts
    are tried one by one, so that an error stays with its row; so is a vector of another
    width than dims or with a number that is not finite.
    """

    def one(texts: list[str]) -> list[tuple[list[float] | None, str | None]]:
        try:
            found = model(texts)
            if len(found) != len(texts):
                raise ValueError(f"{len(found)} vectors for {len(texts)} texts")
        except Exception as e:  # a model may fail in any way; the row says how
            return [x for t in texts for x in one([t])] if len(texts) > 1 else [(None, f"{type(e).__name__}: {e}"[:300])]
        wrong = lambda v: f"width {len(v)}, not {dims}" if len(v) != dims else None if np.isfinite(v).all() else "a number is not finite"
        return [(None, wrong(v)) if wrong(v) else (v, None) for v in found]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, batch):
                part = b.slice(a, batch)
                texts = [t if t and t.strip() else " " for t in part["text"].to_pylist()]
                vectors, errors = zip(*one(texts))
                yield pa.RecordBatch.from_arrays([part["key"], pa.array(vectors, pa.list_(pa.float32())), pa.array(errors, pa.string())], ["key", "vector", "error"])

    kind = rows.schema[key].dataType.simpleString()
    done = rows.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, vector array<float>, error string")
    return done.withColumnRenamed("key", key)


def refreshed(chunks: DataFrame, prior: DataFrame, key: str, text: str, version: str, model: Model, dims: int) -> DataFrame:
    """key, vector, how and error of every chunk: ``reused`` from the newest prior chunk of
    the very same text, ``embedded``, or ``failed``.

    A text is embedded once, however many chunks have it.  prior: text, vector and version.
    """
    known = prior.withColumn("vector", valid_vector(F.col("vector"), dims)).where("vector is not null")
    rows = reuse_embeddings(chunks.select(key, text), known, text, "vector", version).withColumn("hash", F.sha2(F.coalesce(text, F.lit("")), 256))
    rows = written(rows, "embed-known")
    missing = rows.where("vector is null").groupBy("hash").agg(F.first(text).alias(text))
    made = written(embed(missing, "hash", text, model, dims), "embed-made").withColumnRenamed("vector", "new")
    rows = rows.join(made, "hash", "left")
    how = F.when(F.col("vector").isNotNull(), "reused").when(F.col("new").isNotNull(), "embedded").otherwise("failed")
    return rows.select(key, F.coalesce("vector", "new").alias("vector"), how.alias("how"), F.when(F.col("vector").isNull(), F.col("error")).alias("error"))


def stored(chunks: DataFrame, vectors: DataFrame, key: str, dims: int) -> DataFrame:
    """chunks with the vectors that are new and valid in ``embedding``, where the copy in
    ``json`` goes; other chunks stay as they are."""
    new = vectors.select(key, valid_vector(F.col("vector"), dims).alias("new")).where("new is not null")
    there = F.col("new").isNotNull()
    return chunks.join(new, key, "left").withColumns({"embedding": F.coalesce("new", "embedding"), "json": F.when(~there, F.col("json"))}).select(chunks.columns)
