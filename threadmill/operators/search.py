"""Three tiers of retrieval: full text, hybrid and vector."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import cosine, tokens


def query_terms(query: str) -> list[str]:
    """Distinct lower-case terms of a query, in order."""
    import re

    return list(dict.fromkeys(t for t in re.split(r"[^\w]+|_", query.lower()) if t))


def match_all(docs: DataFrame, text: str, terms: list[str]) -> DataFrame:
    """Documents that hold every term, with ``rank``: how often they hold them by
    the logarithm of their length."""
    found = _split(docs, text, terms, all_of=True).where(F.forall(_array(terms), lambda t: F.array_contains("_t", t)))
    return found.withColumn("rank", _rank(terms)).drop("_t")


def match_any(docs: DataFrame, text: str, terms: list[str]) -> DataFrame:
    """Documents that hold any term of two letters or more."""
    terms = [t for t in terms if len(t) > 1]
    found = _split(docs, text, terms, all_of=False).where(F.arrays_overlap("_t", _array(terms)))
    return found.withColumn("rank", _rank(terms)).drop("_t")


def _array(terms: list[str]) -> Column:
    return F.array(*map(F.lit, terms)).cast("array<string>")


def _split(docs: DataFrame, text: str, terms: list[str], all_of: bool) -> DataFrame:
    """docs with tokens, but only those that hold the terms at least as substrings: a
    text that cannot match is not split."""
    low = F.lower(text)
    near = F.lit(all_of and bool(terms))
    for t in terms:
        near = near & F.contains(low, F.lit(t)) if all_of else near | F.contains(low, F.lit(t))
    return docs.where(near).withColumn("_t", tokens(F.col(text)))


def _rank(terms: list[str]) -> Column:
    return F.size(F.filter("_t", lambda t: F.array_contains(_array(terms), t))) / F.log(F.size("_t") + 2.0)


def keyword_search(docs: DataFrame, key: str, text: str, query: str, limit: int, newest: str | None = None) -> DataFrame:
    """All terms; if nothing has them all and there are two or more of two letters,
    any of those; at last the query as a substring, newest first.

    One scan gives every hit its tier, the best of each tier are kept, and of these
    few the first tier that has any stays.
    """
    terms = query_terms(query)
    long = [t for t in terms if len(t) > 1]
    low = F.lower(text)
    like = F.contains(low, F.lit(query.strip().lower()))
    near = like
    for t in terms:
        near = near | F.contains(low, F.lit(t))
    hits = docs.where(near).withColumn("_t", tokens(F.col(text)))
    every = F.forall(_array(terms), lambda t: F.array_contains("_t", t)) if terms else F.lit(False)
    any_ = F.arrays_overlap("_t", _array(long)) if len(long) > 1 else F.lit(False)
    hits = hits.withColumn("_tier", F.when(every, 0).when(any_, 1).when(like, 2)).where("_tier is not null")
    hits = hits.withColumn("rank", F.when(F.col("_tier") == 0, _rank(terms)).when(F.col("_tier") == 1, _rank(long)).otherwise(0.0)).drop("_t")
    late = F.when(F.col("_tier") == 2, F.col(newest)) if newest else F.lit(None)
    order = [F.desc("rank"), F.desc_nulls_last(late) if newest else F.asc(key), F.asc(key)]
    top = hits.withColumn("_n", F.row_number().over(Window.partitionBy("_tier").orderBy(*order))).where(F.col("_n") <= limit)
    first = top.withColumn("_best", F.min("_tier").over(Window.partitionBy(F.lit(0)))).where("_tier = _best")
    return first.orderBy("_n").drop("_tier", "_n", "_best")


def vector_search(vectors: DataFrame, key: str, vector: str, query: list[float], limit: int) -> DataFrame:
    """The nearest by cosine, exactly; only keys and scores are sorted, rows can be
    joined back to the few winners."""
    scored = vectors.select(key, cosine(F.col(vector), F.array(*[F.lit(float(x)) for x in query])).alias("similarity"))
    return scored.orderBy(F.desc("similarity"), key).limit(limit)


def hybrid_search(docs: DataFrame, vectors: DataFrame, key: str, text: str, vector: str, newest: str, query: str, query_vector: list[float], limit: int, prefilter: int = 300, candidates: int = 1000) -> DataFrame:
    """The newest vectors of full-text candidates, if these are ``limit`` or more, or
    else of all rows, reranked by cosine.  newest: a column of docs."""
    ids = keyword_search(docs, key, text, query, prefilter, newest).select(key).withColumn("_hit", F.lit(True))
    enough = ids.agg((F.count(F.lit(1)) >= limit).alias("_enough"))
    pool = docs.select(key, newest).join(vectors, key).join(F.broadcast(ids), key, "left").crossJoin(F.broadcast(enough))
    pool = pool.where(~F.col("_enough") | F.col("_hit").isNotNull())
    return vector_search(pool.orderBy(F.desc_nulls_last(newest), key).limit(candidates), key, vector, query_vector, limit)


def widened(scoped: DataFrame, wide: DataFrame, key: str, order: Column, enough: int = 3, most: int = 6) -> DataFrame:
    """Scoped results first; if they are fewer than enough, wider ones that are not
    among them, up to most in all."""
    few = scoped.agg((F.count(F.lit(1)) < enough).alias("few"))
    more = wide.join(scoped.select(key), key, "left_anti").crossJoin(F.broadcast(few)).where("few").drop("few")
    both = scoped.withColumn("tier", F.lit(0)).unionByName(more.withColumn("tier", F.lit(1)))
    return both.orderBy("tier", order, key).limit(most)


def hydrate(ranked: DataFrame, rows: DataFrame, key: str, rank: Column) -> DataFrame:
    """Rows of the few ranked keys with ``place`` (1, 2, ... by rank, an ordering, and key)
    and in this order; keys without a row are left out, places stay."""
    placed = ranked.withColumn("place", F.row_number().over(Window.orderBy(rank, key)))
    return placed.join(rows, key).orderBy("place")
