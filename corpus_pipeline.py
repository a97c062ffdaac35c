"""Corpus pipeline: quality filter, line dedup, near-duplicate documents, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and
read again as the next one's ``docs``.  All but the last keep the columns of
``documents``; n_chars follows the text.  Null and empty texts pass all stages as
documents without lines, links or spans, and are packed as one end id.  Every row is
a document of its own, also where ids are null or repeat: a copy takes no other row of
its id along.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioworks.llm import jaccard, line_dedup, packing, pii, quality
from folioworks.llm.common import Scratch

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.score_documents(docs, labels, keep=COLUMNS).where("predicted = 1").select(*COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every line that repeats an earlier one, exactly or nearly, goes; documents stay, if need be empty."""
    out = line_dedup.dedup_lines(docs.select(*COLUMNS))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked rows one stays: that of least id, null ids last, of equal ids the first read."""
    scratch = Scratch(spark, "copies")
    rows = line_dedup.named_rows(docs.select(*COLUMNS), scratch)
    linked = jaccard.link_documents(rows.select(F.col("__row").alias("doc_id"), "text"))
    groups = linked.select(F.col("doc_id").alias("__row"), "component_id").join(rows.select("__id", "__row"), "__row")
    stays = groups.groupBy("component_id").agg(F.min(F.struct("__id", "__row"))["__row"].alias("__row")).select("__row")
    return rows.join(stays, "__row", "left_semi").select(*COLUMNS)


def mask_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by the name of its kind."""
    out = pii.find(docs.select(*COLUMNS), keep=("doc_id", "lang", "source"), mask="text")
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 ids; one row per piece."""
    return packing.pack(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality", keep_good), ("lines", drop_lines), ("near_duplicates", drop_copies), ("pii", mask_personal), ("packing", pack)]
ORACLE_SQL = None  # learned scores, hashes of words and edit distances are beyond SQL; tests hold it against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.save(docs)
    return docs
