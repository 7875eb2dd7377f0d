"""A corpus pipeline over ``documents``: each stage works on all that the one before kept.

Stages are (name, function); a function takes (spark, docs, sf_dir) and returns a
DataFrame. All but the last return the columns of documents. run() writes the result of each
stage to the shared folder and removes what the stage made on its way, and the result of
the stage before.

Defined results: a null or empty text, or one without letters, has no language and goes at
the first stage; of rows that repeat a doc_id each is a row of its own, and of equal texts
the one with the smallest doc_id stays (a null doc_id comes last); other columns stay with
their rows, whatever their names; an empty table of documents gives an empty result, an
empty benchmark drops nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyspark.llm.common import remove, scratch, shared_dir, written_to
from tallyspark.llm.decontaminate import drop_contaminated
from tallyspark.llm.exact_dedup import drop_copies
from tallyspark.llm.language import keep_identified
from tallyspark.llm.pieces import encode_decode
from tallyspark.llm.simhash import drop_near_copies


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that language ID rejects go."""
    return keep_identified(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the smallest doc_id stays."""
    return drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the document with the smallest doc_id stays."""
    return drop_near_copies(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids and decoded text of what is left."""
    import public_tokenizers

    return encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("language_id", language_id), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup),
    ("decontaminate", decontaminate), ("encode", encode),
]

#: SQL expresses neither compression nor tiling nor the encoder; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = shared_dir(spark, name)
        with scratch(spark):
            docs = written_to(stage(spark, docs, sf_dir), path)
        if before:
            remove(spark, before)
        before = path
    return docs
