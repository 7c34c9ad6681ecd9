"""The registered queries of this package: one opN_<name> for each operator.

Each query applies its operator with production parameters to the whole of its
table and derives the columns of its contract from the operator's output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import lines, lloyd, mixing, neardup_texts, neardup_vectors, quality, sharding, spelling, suffix_dedup, toxicity, transducer, warc, wordpieces

PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.quality_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _op4_sql() -> str:
    grams, joins, over = [], [], []
    for n, limit in quality.NGRAM_LIMITS.items():
        grams.append(
            f"""g{n} AS (SELECT doc_id, pos, max(CASE WHEN rn > 1 THEN 1 ELSE 0 END) OVER w AS later, max(CASE WHEN c > 1 THEN 1 ELSE 0 END) OVER w AS again
  FROM (SELECT doc_id, pos, row_number() OVER (PARTITION BY doc_id, gram ORDER BY pos) AS rn, count(*) OVER (PARTITION BY doc_id, gram) AS c
        FROM (SELECT doc_id, pos, CASE WHEN pos + {n - 1} <= len(ws) THEN array_to_string(ws[pos:pos + {n - 1}], ' ') ELSE '\n' || pos END AS gram FROM w))
  WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)),
c{n} AS (SELECT doc_id, sum(later * length(w.word)) AS chars, sum(again) AS again FROM g{n} JOIN w USING (doc_id, pos) GROUP BY doc_id)"""
        )
        joins.append(f"LEFT JOIN c{n} USING (doc_id)")
        over.append(f"100 * coalesce(c{n}.chars, 0) > {limit} * word_chars")
    return rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
l AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
w AS (SELECT doc_id, ws, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS pos FROM l),
{", ".join(grams)},
lines AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line) AS rn, list_sum(list_transform(regexp_extract_all(line, '[^\x20\x09-\x0D]+'), lambda x: length(x))) AS chars
  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
ln AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (rn > 1) AS dups, coalesce(sum(chars) FILTER (rn > 1), 0) AS chars FROM lines GROUP BY doc_id),
b AS (SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols FROM l),
m AS (SELECT b.*, coalesce(ln.dups, 0)::BIGINT AS n_dup_lines, coalesce(c{quality.BASE_NGRAM}.again, 0)::BIGINT AS n_repeat_words,
  100 * coalesce(ln.dups, 0) > {quality.LINE_LIMIT} * coalesce(ln.n_lines, 0) OR 100 * coalesce(ln.chars, 0) > {quality.LINE_CHAR_LIMIT} * word_chars OR {" OR ".join(over)} AS over_limit
  FROM b LEFT JOIN ln USING (doc_id) {" ".join(joins)})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND NOT over_limit AS kept FROM m"""


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents are shuffled; the digest columns come from what arrives."""
    out = sharding.shard(read(spark, sf_dir, "documents"), 8)
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    text_crc32 = F.crc32(F.coalesce("text", F.lit("")))
    return out.select("doc_id", size.alias("size"), text_crc32.alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup_vectors.near_duplicates(read(spark, sf_dir, "embeddings"))


def op3_token_counts(spark: SparkSession, sf_dir: str, piece_model: str = PIECE_MODEL) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return wordpieces.token_counts(docs, wordpieces.read_vocabulary(piece_model)).select("doc_id", "n_tokens")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = toxicity.held_out(F.col("doc_id"))
    index, prior = toxicity.train(docs, read(spark, sf_dir, "labels"), ~out)
    return toxicity.score(docs, index, prior).select("doc_id", out.alias("held_out"), "score", "predicted", "evidence")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.round_trip(read(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup_texts.near_duplicates(read(spark, sf_dir, "documents"), words=4, percent=85)


def op8_sentencepiece(spark: SparkSession, sf_dir: str, piece_model: str = PIECE_MODEL) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return transducer.encode_digest(docs, transducer.Transducer.read(piece_model)).drop("text")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = suffix_dedup.remove_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"))
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["start"])
    return docs.select("doc_id", n_bytes.alias("n_bytes"), gone.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    taken = (F.col("size") * F.col("times")).cast("long").alias("taken")
    return mixing.mix_plan(docs, ["doc_id"]).select("doc_id", "size", "source_size", "target", taken)


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(read(spark, sf_dir, "documents").select("doc_id", "text"))


#: CRC-32 by its table over the bytes of ASCII and Latin-1 letters; two words are near
#: if they are equal without one code point at the same place, or if one is the other
#: without one.
_OP11_SQL = r"""WITH RECURSIVE tab AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda a, b: CASE WHEN a & 1 = 1 THEN xor(3988292384::BIGINT, a >> 1) ELSE a >> 1 END)) AS t),
o AS (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS c
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]{7,}')) AS run FROM documents) GROUP BY 1, 2),
b AS (SELECT *, flatten(list_transform(string_split(doc_id || ':' || run, ''), lambda s: CASE WHEN unicode(s) < 128 THEN [unicode(s)] ELSE [192 | (unicode(s) >> 6), 128 | (unicode(s) & 63)] END)) AS bytes FROM o),
h AS (SELECT run, c, xor(4294967295::BIGINT, list_reduce(list_concat([4294967295::BIGINT], bytes::BIGINT[]), lambda a, x: xor(t[(xor(a, x) & 255) + 1], a >> 8))) AS h FROM b, tab),
w AS (SELECT CASE WHEN h % 31 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, c FROM h),
words AS (SELECT word, sum(c)::BIGINT AS n FROM w WHERE length(word) >= 7 GROUP BY word HAVING sum(c) >= 2),
cut AS (SELECT word, pos, left(word, pos) || substr(word, pos + 2) AS less FROM (SELECT word, unnest(range(length(word))) AS pos FROM words)),
pairs AS (SELECT a.word AS a, b.word AS b FROM cut a JOIN cut b ON a.less = b.less AND a.pos = b.pos AND a.word <> b.word
  UNION SELECT word, less FROM cut WHERE less IN (SELECT word FROM words) UNION SELECT less, word FROM cut WHERE less IN (SELECT word FROM words)),
best AS (SELECT a, count(*) AS n_near, first(b ORDER BY x.n DESC, b) AS b, max(x.n) AS bn FROM pairs JOIN words x ON x.word = b GROUP BY a),
f AS (SELECT word, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN bn >= 10 * n THEN b END AS form, CASE WHEN bn >= 10 * n THEN bn END AS form_n FROM words LEFT JOIN best ON a = word),
r AS (SELECT word, word AS at FROM f UNION ALL SELECT r.word, f.form FROM r JOIN f ON f.word = r.at WHERE f.form IS NOT NULL),
root AS (SELECT r.word, r.at AS root FROM r JOIN f ON f.word = r.at WHERE f.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM f JOIN root USING (word)"""


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lloyd.clustered(read(spark, sf_dir, "embeddings"))


def _op12_sql() -> str:
    steps = []
    for i in range(lloyd.ROUNDS + 1):
        steps.append(f"""d{i} AS (SELECT v.id, k, list_sum(list_transform(list_zip(v.e, c.e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS dist FROM v, c{i} c),
a{i} AS (SELECT id, arg_min(k, (dist, k)) AS k, min(dist) AS dist FROM d{i} GROUP BY id)""")
        if i < lloyd.ROUNDS:
            steps.append(f"""s{i} AS (SELECT k, j, sum(x) AS s, count(*) AS n FROM (SELECT k, unnest(e) AS x, unnest(range({lloyd.DIMS})) AS j FROM a{i} JOIN v USING (id)) GROUP BY k, j),
c{i + 1} AS (SELECT k, coalesce(m.e, c{i}.e) AS e FROM c{i} LEFT JOIN (SELECT k, list(((s - (s % n + n) % n) // n)::BIGINT ORDER BY j) AS e FROM s{i} GROUP BY k) m USING (k))""")
    last = lloyd.ROUNDS
    return f"""WITH v AS MATERIALIZED (SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE len(embedding) = {lloyd.DIMS} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS (SELECT (row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1)::INT AS k, e FROM v QUALIFY k < {lloyd.CLUSTERS}),
{", ".join(s.replace(" AS (", " AS MATERIALIZED (", 1) for s in steps)}
SELECT vec_id, a{last}.k AS cluster, a{last}.dist AS distance, (sum(a{last}.dist) OVER (PARTITION BY a{last}.k))::BIGINT AS cluster_inertia, (sum(a{last}.dist) OVER ())::BIGINT AS inertia, sha256(array_to_string(c{last}.e, ',')) AS centroid_sha256
FROM a{last} JOIN v USING (id) JOIN c{last} ON c{last}.k = a{last}.k"""


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


_OP13_SQL = r"""WITH l AS (SELECT doc_id, line, pos, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents)),
s AS (SELECT key, min(doc_id) AS first FROM l WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (doc_id > first) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (doc_id <= coalesce(first, doc_id)), '')) AS kept_sha256
FROM l LEFT JOIN s USING (key) GROUP BY doc_id"""


QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_embedding_neardup": op2_embedding_neardup,
    "op3_token_counts": op3_token_counts,
    "op4_quality_rules": op4_quality_rules,
    "op5_toxicity": op5_toxicity,
    "op6_warc": op6_warc,
    "op7_ngram_jaccard": op7_ngram_jaccard,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_mixing": op10_mixing,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_centroid_clustering": op12_centroid_clustering,
    "op13_line_dedup": op13_line_dedup,
}
ORACLES = {
    "op2_embedding_neardup": """WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
r(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY a)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)""",
    "op4_quality_rules": _op4_sql(),
    "op6_warc": """WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
g AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha1(b) AS payload_digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM g)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN again THEN top END AS refers_to, true AS intact FROM (SELECT *, payload_bytes >= 1000 AND page_id <> top AS again FROM m)""",
    "op11_spelling_variants": _OP11_SQL,
    "op12_centroid_clustering": _op12_sql(),
    "op13_line_dedup": _OP13_SQL,
}
