"""Queries of the operators on text and vectors (problems 3, 6, 7, 8 and 9)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import defects, encoding, lookalike, mixing, neighbours
from quern.plans.scratch import cut


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _pair_defects(spark: SparkSession, d: str) -> DataFrame:
    """Both tables of pairs, each under its own names for question and answer."""
    tuned = table(spark, d, "llm_fine_tune").select("pair_id", F.col("instruction").alias("question"), F.col("response").alias("answer"), "context")
    prompts = table(spark, d, "prompt_embeddings").select("pair_id", F.col("prompt").alias("question"), F.col("response").alias("answer"), F.lit(None).cast("string").alias("context"))
    return defects.pair_defects(tuned.unionByName(prompts))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _pair_defects(spark, d).select("pair_id", F.col("defects")[0].alias("defect"))


def p3_all_defects(spark: SparkSession, d: str) -> DataFrame:
    return _pair_defects(spark, d).select("pair_id", F.explode("defects").alias("defect"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.neighbour_pairs(table(spark, d, "prompt_embeddings"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return encoding.encode_documents(table(spark, d, "documents"))


def _mixed(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    marks = [F.col("source"), F.col("lang"), mixing.topic_of(F.col("repo")).alias("topic")]
    # counted once and kept in the shared folder: a few values a document
    sized = cut(encoding.encode_documents(docs, lengths=True, keep=marks))
    return mixing.mix(sized, table(spark, d, "source_targets"))


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d).select("doc_id", "source", "n_tokens", "weight", "copies")


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(_mixed(spark, d), table(spark, d, "source_targets"))


def p8_marginals(spark: SparkSession, d: str) -> DataFrame:
    return mixing.marginals(_mixed(spark, d))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.look_alike_pairs(table(spark, d, "documents"))


def p9_classes(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.look_alike_classes(table(spark, d, "documents")).select("doc_id", "class_id", "spelling_id", "spellings")


def p9_canonical(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.canonical_texts(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p3_found, p3_all_defects, p6_found, p7_ids, p8_mix, p8_shares, p8_marginals, p9_found, p9_classes, p9_canonical)}
ORACLE: dict[str, str] = {
    # every pair is compared
    "p6_found": """
        with v as (select distinct pair_id, embedding::double[] as e from prompt_embeddings where len(embedding) = 64
            and len([x for x in embedding if x is null or isnan(x) or isinf(x)]) = 0 and len([x for x in embedding if x <> 0]) > 0),
        s as (select a.pair_id as x, b.pair_id as y, round(list_cosine_similarity(a.e, b.e), 12) as sim from v a join v b on a.pair_id <> b.pair_id),
        r as (select x, y from (select x, y, row_number() over (partition by x order by sim desc, y) as k from s) where k <= 5)
        select distinct least(x, y) as pair_id_1, greatest(x, y) as pair_id_2 from r""",
}
