"""The corpus pipeline: five stages from raw documents to training ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame: all but the last
return the columns of ``docs``. Written as Parquet and read again, a stage's
result is the next one's ``docs``; ``run`` chains them over ``documents`` with a
checkpoint after each stage, so that every stage works once.

Null, empty, repeated and long rows have the results that each operator's
module states; an empty table goes through all stages and comes out empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parley.llm import mixing, pseudonyms, quality_classifier, sentence_pieces, simhash
from parley.session import cut_lineage


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    model = quality_classifier.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_classifier.keep_quality(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash.keep_one(docs)


def pseudonymise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets replaced by pseudonyms of the same format."""
    return pseudonyms.replace(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every document; repeats of the mix have draws of their own."""
    text = F.xxhash64("text")
    same = Window.partitionBy("doc_id", F.when(F.col("doc_id").isNull(), text)).orderBy(text)
    return sentence_pieces.segment(docs.select("doc_id", "text", F.row_number().over(same).alias("repeat")), repeat="repeat")


STAGES = [
    ("quality_classifier", keep_quality),
    ("simhash_near_dedup", drop_near_copies),
    ("pii", pseudonymise),
    ("mixing", mix_sources),
    ("sentence_pieces", encode),
]

#: Trained scores, keyed hashes and piece merges are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut_lineage(docs)
    return docs
