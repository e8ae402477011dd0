"""A corpus pipeline of five operators: (name, function) stages, each over all that its predecessor kept.

Every function takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
each stage's result as Parquet to the shared folder and reads it again as the
next one's docs. All but the last stage return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from strandline.llm import jaccard_join, mixing, packing, quality_rules, toxicity
from strandline.runtime import ensure_checkpoint_dir, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the likelihood ratio."""
    return quality_rules.keep(docs, table(spark, sf_dir, "labels"))


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    return toxicity.keep(docs, table(spark, sf_dir, "labels"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the smallest doc_id."""
    return jaccard_join.keep_one(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.resample(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens with their sequence and place there."""
    return packing.pack_documents(docs)


STAGES = [("quality rules", quality), ("toxicity", not_toxic), ("n-gram Jaccard join", one_of_each), ("mixing sources to target weights", mixed), ("best-fit packing", packed)]

#: Hashing, a trained classifier and tokens are beyond SQL; tests/llm compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, read from its folder; a folder goes when the next stage has been written."""
    ensure_checkpoint_dir(spark)
    base = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{base}/{k}")
        docs = spark.read.schema(out.schema).parquet(f"{base}/{k}")
        if k:
            gone = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/{k - 1}")
            gone.getFileSystem(spark._jsc.hadoopConfiguration()).delete(gone, True)
    return docs
