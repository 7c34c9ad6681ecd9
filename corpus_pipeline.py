"""From raw documents to encoded training text, in five written stages.

Every stage takes (spark, docs, sf_dir) and works on all rows that its
predecessor kept.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadmill.llm import mixing, neardup_texts, suffix_dedup, toxicity, transducer
from threadmill.llm.shared import sized, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic.  Held-out labels teach nothing.

    Null and empty texts score the share of toxic labels; repeated rows share their
    fate.  Without labels of both classes every row scores that share.
    Further columns of docs are dropped, here and in every stage.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    index, prior = toxicity.train(docs, labels, ~toxicity.held_out(F.col("doc_id")))
    return toxicity.score(docs.select(COLUMNS), index, prior, evidence=0).where("predicted = 0").select(COLUMNS)


def _hashed(docs: DataFrame) -> DataFrame:
    """docs with t1 and t2, which with doc_id tell rows apart."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(*COLUMNS, F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2"))


def _same():
    """Join condition: the row of that doc_id (or of none) and text."""
    return F.col("d.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("d.t1") == F.col("r.t1")) & (F.col("d.t2") == F.col("r.t2"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group that shares 80 % of its five-word shingles,
    in the order of doc_id (nulls last) and two hashes of the text.  Of rows that
    are equal in doc_id and text, one stays.  Null and empty texts are near to
    nothing and stay, once for each doc_id.  An empty table stays empty."""
    groups = neardup_texts.near_duplicates(docs, words=5, percent=80, hashes=True)
    stays = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("t1") == F.col("first.t1")) & (F.col("t2") == F.col("first.t2"))
    gone = groups.where(~stays).select("doc_id", "t1", "t2").distinct()
    gone = sized(written(gone, "near-copies"))
    rows = _hashed(docs)
    kept = rows.alias("d").join(gone.alias("r"), _same(), "left_anti")
    again = rows.groupBy("doc_id", "t1", "t2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    again = written(again, "repeated-rows")
    if again.isEmpty():
        return kept.select(COLUMNS)
    again = sized(again)
    once = kept.alias("d").join(again.alias("r"), _same(), "left_anti").select(COLUMNS)
    more = kept.alias("d").join(again.alias("r"), _same(), "left_semi")
    one = more.groupBy("doc_id", "t1", "t2").agg(F.min(F.struct("text", "lang", "source", "n_chars")).alias("one"))
    return once.unionByName(one.select("doc_id", "one.*").select(COLUMNS))


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 50 bytes or more that an earlier document has.

    Null texts stay null; rows with a null doc_id stay whole; rows of one doc_id are
    not earlier than each other.  Documents stay, if with an empty text.
    """
    done = suffix_dedup.remove_repeats(docs.select(COLUMNS), whole_characters=True)
    text = F.when(F.col("text").isNotNull(), F.decode("kept", "UTF-8"))
    done = done.withColumn("text", text)
    return done.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")).select(COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it (0 to 2 times).

    Null and empty texts have no words and are never taken; a null source is a
    source, the last.  Of equal hashes the smaller doc_id is taken first.
    """
    rows = _hashed(docs)
    plan = mixing.mix_plan(rows, ["doc_id", "t1", "t2"]).where("times > 0").select("doc_id", "t1", "t2", "times")
    plan = sized(written(plan, "mix-times"))
    taken = rows.alias("d").join(plan.alias("r"), _same()).select("d.*", "r.times")
    return taken.withColumn("turn", F.explode(F.sequence(F.lit(1), "times"))).select(COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source and the piece ids of every document of the mix; null and empty
    texts have none.  Repeated rows are coded alike."""
    fst = transducer.Transducer.read(PIECE_MODEL)
    coded = transducer.encode(docs.select("doc_id", "source", "text"), fst)
    return coded.select("doc_id", "source", F.size("ids").cast("long").alias("n_pieces"), "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("suffix_array_dedup", drop_repeated_passages),
    ("mixing", mix_sources),
    ("sentencepiece", encode),
]

#: Nearest-neighbour scores and knapsack picks have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
