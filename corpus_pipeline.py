"""A training-data pipeline: language, toxicity, near duplicates, mixture, packing."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import langid, mixing, ngram_join, packing, toxicity
from quire.llm.common import staged

#: Least mean probability of a document's language over its bytes.
LEAST_LANGUAGE_SCORE = 0.5
#: Documents with this probability of the toxic label, or more, go.
TOXIC_SCORE = 0.5
#: Words that packing keeps the ids of: beside a heap that the stages before have filled, a worker has less room.
PACK_WORDS = 300_000


def small_batches(stage):
    """Texts go to Python packing.BATCH_BYTES at once, for this session from here on, as stages are written after they return."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{packing.BATCH_BYTES}b")
        return stage(spark, docs, sf_dir)

    return run


@small_batches
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go that have no letters (`und`) or no language with a score of LEAST_LANGUAGE_SCORE."""
    model = langid.train(docs)
    found = docs.withColumn("_p", langid.predict(spark, model, F.col("text").cast("string")))
    return found.where((F.col("_p.lang_pred") != "und") & (F.col("_p.score") >= LEAST_LANGUAGE_SCORE)).drop("_p")


@small_batches
def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are likelier toxic than not go."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.where(toxicity.score(spark, model, F.col("text").cast("string")) < TOXIC_SCORE)


@small_batches
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by five-word shingles at 0.8 or more, the document of least id stays.

    Of rows that share an id one stays; rows without an id all stay. Only texts whose id may be one
    of those looked for are dealt by id.
    """
    found = ngram_join.similar_components(docs, k=5, threshold=(80, 100)).where("doc_id IS NOT NULL")
    found = staged(found.groupBy("doc_id").agg(F.min("component_id").alias("component_id"), F.count("*").alias("rows")), "groups")
    apart = found.where("component_id <> doc_id OR rows > 1").select("doc_id")
    repeated = found.where("component_id = doc_id AND rows > 1").select("doc_id")
    marked = docs.withColumn("_may", ngram_join.may_hold(spark, apart.withColumnRenamed("doc_id", "id"), "doc_id"))
    sure, rest = marked.where("NOT _may"), marked.where("_may").join(apart, "doc_id", "left_anti")
    twice = docs.where(ngram_join.may_hold(spark, repeated.withColumnRenamed("doc_id", "id"), "doc_id"))
    one = twice.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return sure.select(*docs.columns).union(rest.select(*docs.columns)).union(one.select(*docs.columns))


@small_batches
def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mixture takes them."""
    return mixing.mix(docs)


@small_batches
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=2048, cache_words=PACK_WORDS)


STAGES = [("language_id", language_id), ("toxicity", toxic), ("ngram_jaccard", near_duplicates), ("mixing", mixture), ("packing", packed)]

#: The models, the join and the packing have no SQL; tests compare run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
