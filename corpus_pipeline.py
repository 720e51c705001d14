"""The corpus pipeline: documents through toxicity, near duplicates, benchmark decontamination, mixing and sharding.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the next stage's docs. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratagraph.llm import decontaminate, jaccard_join, mixing, shards, toxicity
from stratagraph.llm.common import dropped, scratch, written


def _columns(docs: DataFrame, like: DataFrame) -> DataFrame:
    return docs.select(*[docs[c] for c in like.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labels of documents that are not held out, rejects (score >= 0.5) go."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _columns(toxicity.score(docs, model).where("predicted = 0"), docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of five-word shingle likeness 0.8 or more, the document with the least doc_id stays; so do texts
    without words and rows without doc_id. Rows with the kept doc_id all stay."""
    found = jaccard_join.jaccard_components(docs, k=5, threshold="0.8").where("component_id < doc_id").select(F.col("doc_id").alias("gone")).distinct()
    return _columns(docs.join(found, docs["doc_id"] == F.col("gone"), "left_anti"), docs)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans that hold benchmark windows are cut out of the texts, and n_chars follows; texts without a hit stay as they are."""
    found = decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), cleaned=True)
    found = found.withColumn("text", F.when(F.col("n_hit") > 0, F.col("clean_text")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.when(F.col("n_hit") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return found.select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mixture takes it."""
    return mixing.mix(docs, weights=(5, 2, 1), share=1.5, cap=2.0)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with their shard and slot."""
    return shards.shuffle_into_shards(docs, shards=8)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("benchmark_decontamination", cut_benchmark),
    ("source_mixing", mix_sources),
    ("sharding", shard),
]

#: The trained classifier and the shuffle have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES[:-1]:
        with scratch() as keep:  # what a stage wrote on its way goes when its result is there, and so does the stage before
            docs = keep(written(stage(spark, docs, sf_dir), f"pipeline-{name}"))
        if before is not None:
            dropped(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
