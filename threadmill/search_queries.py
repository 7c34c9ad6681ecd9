"""Registered queries of the text and vector indexes, with their SQL.

Documents stand in for chunks, and their ids for the time they were made.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .catalog import query, read
from .operators import fulltext as X
from .operators import ivf as V
from .tables import scratch

#: Every form of the query language and their nesting; the SQL below says each anew.
FORMS = [
    "clown",
    "released license",
    '"MIT License"',
    'idiot OR "gnu general public" license or clown',
    "license -mit",
    '-"mit license" released -gnu',
    "-the -de -in -der",
    "and, of, the",
]

_WORDS = r"""w AS (SELECT doc_id, term, pos FROM (SELECT doc_id, unnest(ws) AS term, unnest(range(len(ws))) AS pos FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS ws FROM %s)))"""
# Words n, doc and rank of (doc_id, n) matches; q holds the words of each query and how they are ranked.
_RANKS = """occ AS (SELECT doc_id, term, sum(1.0::DOUBLE / (j * j)) AS s FROM (SELECT doc_id, term, row_number() OVER (PARTITION BY doc_id, term ORDER BY pos) AS j FROM w) GROUP BY ALL),
loose AS (SELECT n, m.doc_id, 0.1 * coalesce(sum(s), 0) / 1.64493406685 / any_value(size) AS rank FROM m JOIN (SELECT n, unnest(terms) AS term, len(terms) AS size, joined FROM q) USING (n) LEFT JOIN occ ON occ.doc_id = m.doc_id AND occ.term = q_term(term) WHERE NOT joined GROUP BY ALL),
pairs AS (SELECT m.n, m.doc_id, abs(a.pos - b.pos) AS d FROM m JOIN q USING (n) JOIN w a ON a.doc_id = m.doc_id AND list_contains(terms, a.term) JOIN w b ON b.doc_id = m.doc_id AND list_contains(terms, b.term) AND a.term < b.term WHERE joined),
near AS (SELECT n, doc_id, 1 - exp(sum(ln(1 - 0.1 * sqrt(CASE WHEN d > 100 THEN 1e-30 ELSE 1 / (1.005 + 0.05 * exp(d / 1.5 - 2)) END)))) AS rank FROM pairs GROUP BY ALL),
ranked AS (SELECT n, doc_id, rank FROM loose UNION ALL SELECT n, m.doc_id, coalesce(rank, 1e-20) FROM m JOIN q USING (n) LEFT JOIN near USING (n, doc_id) WHERE joined)""".replace("q_term(term)", "q.term").replace("joined FROM q) USING (n)", "joined FROM q) q USING (n)")


def _has(term: str) -> str:
    return f"doc_id IN (SELECT doc_id FROM w WHERE term = '{term}')"


def _phrase(*terms: str) -> str:
    joins = " ".join(f"JOIN w w{i} ON w{i}.doc_id = w0.doc_id AND w{i}.pos = w0.pos + {i} AND w{i}.term = '{t}'" for i, t in enumerate(terms) if i)
    return f"doc_id IN (SELECT w0.doc_id FROM w w0 {joins} WHERE w0.term = '{terms[0]}')"


_FORM_SQL = [
    (_has("clown"), ["clown"], False),
    (f"{_has('released')} AND {_has('license')}", ["released", "license"], True),
    (_phrase("mit", "license"), ["mit", "license"], True),
    (f"{_has('idiot')} OR {_phrase('gnu', 'general', 'public')} AND {_has('license')} OR {_has('clown')}", ["idiot", "gnu", "general", "public", "license", "clown"], False),
    (f"{_has('license')} AND NOT {_has('mit')}", ["license", "mit"], True),
    (f"NOT {_phrase('mit', 'license')} AND {_has('released')} AND NOT {_has('gnu')}", ["mit", "license", "released", "gnu"], True),
    (" AND ".join(f"NOT {_has(t)}" for t in ("the", "de", "in", "der")), ["the", "de", "in", "der"], True),
    (" AND ".join(_has(t) for t in ("and", "of", "the")), ["and", "of", "the"], True),
]


def _fts_forms_sql() -> str:
    q = " UNION ALL ".join(f"SELECT {n} AS n, {terms} AS terms, {joined} AS joined" for n, (_, terms, joined) in enumerate(_FORM_SQL))
    m = " UNION ALL ".join(f"SELECT {n} AS n, doc_id FROM documents WHERE {where}" for n, (where, _, _) in enumerate(_FORM_SQL))
    return f"WITH {_WORDS % 'documents'}, q AS ({q}), m AS ({m}), {_RANKS} SELECT n::INT AS query, doc_id, round(rank, 9) AS rank FROM ranked"


def indexed(docs: DataFrame) -> str:
    path = scratch(docs.sparkSession, "fts")
    X.build(docs, "doc_id", "text", path)
    return path


@query(_fts_forms_sql())
def fts_forms(spark, d):
    """All documents that each query of FORMS describes, with their rank, from the index."""
    path = indexed(read(spark, d, "documents"))
    hits = [X.search(spark, path, text).withColumn("query", F.lit(n)) for n, text in enumerate(FORMS)]
    return reduce(DataFrame.unionByName, hits).select("query", F.col("doc").alias("doc_id"), F.round("rank", 9).alias("rank"))


@query(rf"""WITH now AS (SELECT doc_id, CASE WHEN source = 'src1' THEN 'moved license ' || coalesce(text, '') ELSE text END AS text FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)),
{_WORDS % 'now'}, q AS (SELECT 0 AS n, ['license', 'moved'] AS terms, false AS joined), m AS (SELECT 0 AS n, doc_id FROM now WHERE {_has('license')} OR {_has('moved')}), {_RANKS}
SELECT doc_id, round(rank, 9) AS rank FROM ranked""")
def fts_current(spark, d):
    """What the index says after documents were changed and others deleted: nothing of
    what they were."""
    docs, labels = read(spark, d, "documents").select("doc_id", "text", "source"), read(spark, d, "labels")
    path = indexed(docs)
    changed = docs.where("source = 'src1'").withColumn("text", F.concat(F.lit("moved license "), F.coalesce("text", F.lit(""))))
    X.upsert(spark, path, changed, None, "doc_id", "text")
    X.upsert(spark, path, changed.limit(0), labels.where("toxic = 1").select("doc_id"), "doc_id", "text")
    return X.search(spark, path, "license OR moved").select(F.col("doc").alias("doc_id"), F.round("rank", 9).alias("rank"))


_TIERS = ["released license", "clown nosuchword", "worthl"]


@query(rf"""WITH {_WORDS % 'documents'}, q AS (SELECT 0 AS n, ['released', 'license'] AS terms, true AS joined UNION ALL SELECT 1, ['clown', 'nosuchword'], false),
m AS (SELECT 0 AS n, doc_id FROM documents WHERE {_has('released')} AND {_has('license')} UNION ALL SELECT 1, doc_id FROM documents WHERE {_has('clown')}), {_RANKS},
places AS (SELECT n, doc_id, row_number() OVER (PARTITION BY n ORDER BY round(rank, 12) DESC, doc_id) AS place FROM ranked UNION ALL SELECT 2, doc_id, row_number() OVER (ORDER BY doc_id DESC) FROM documents WHERE contains(lower(text), 'worthl'))
SELECT n::INT AS query, doc_id, place::INT AS place FROM places WHERE place <= 20""")
def fts_tiers(spark, d):
    """The best twenty of a query that all words answer, of one that some do, and of one
    that only a part of a word does, newest first."""
    docs = read(spark, d, "documents")
    path = indexed(docs)
    hits = [X.keyword_search(spark, path, docs, "doc_id", "text", "doc_id", text, 20).withColumn("query", F.lit(n)) for n, text in enumerate(_TIERS)]
    return reduce(DataFrame.unionByName, hits).select("query", F.col("doc").alias("doc_id"), F.col("place").cast("int").alias("place"))


#: Lists that a query of ivf_topk reads, of LISTS: the test tables hold random directions,
#: whose neighbours are spread over many lists.
PROBES = 50


def _ivf(spark, d, probes: int) -> DataFrame:
    rows, path = read(spark, d, "embeddings"), scratch(spark, "ivf")
    V.build(rows, "vec_id", "embedding", path)
    return V.topk(spark, path, rows.where("vec_id % 100 = 0"), "vec_id", "embedding", probes, 10).select("query", F.col("key").alias("vec_id"), F.round("similarity", 9).alias("similarity"), "place")


@query("""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE list_sum(list_transform(embedding, lambda x: abs(x))) > 0)
SELECT query, vec_id, round(s, 9) AS similarity, place::INT AS place FROM (SELECT a.vec_id AS query, b.vec_id AS vec_id, list_cosine_similarity(a.e, b.e) AS s, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_cosine_similarity(a.e, b.e) DESC, b.vec_id) AS place FROM v a, v b WHERE a.vec_id % 100 = 0) WHERE place <= 10""")
def ivf_all_lists(spark, d):
    """With every list probed the index gives the exact nearest ten of each query."""
    return _ivf(spark, d, V.LISTS)


@query()
def ivf_topk(spark, d):
    """The nearest ten of each query in its PROBES nearest lists; no SQL, as the centroids
    are fitted.  Recall is tested and stated in the README."""
    return _ivf(spark, d, PROBES)
