"""The corpus pipeline: language ID, near duplicates, personal data, mixing, packing.

STAGES are applied in order, each to all rows that the one before kept; each result is
written as Parquet in the shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbitlake.llm import langid, mixing, packing, parity_join, pii
from orbitlake.llm.common import Scratch
from orbitlake.llm.queries import HELD_OUT, tokenizer_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts whose language cannot be told (`und`) go; the others carry the predicted one."""
    model = langid.fit(docs.where(f"doc_id IS NOT NULL AND NOT {HELD_OUT}"), key=F.col("doc_id"))
    said = langid.identify(docs, model, list(COLUMNS))
    return said.where("lang_pred <> 'und'").withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the smallest id stays; rows without words or id stay as they are."""
    groups = parity_join.parity_join(docs).where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(groups, "doc_id", "left_anti").select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every found span becomes its kind in brackets; all documents stay."""
    clean = pii.redact(docs.select(*COLUMNS))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn by their calibrated probabilities."""
    return mixing.mix(docs).where("mix_kept").select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_path())


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("mixture", mixture), ("packed", packed)]
#: No stage but redaction is plain SQL; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage; tables of earlier stages are removed when the next one is written."""
    docs, held = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "pipeline")
    for name, stage in STAGES:
        docs = held.put(name, stage(spark, docs, sf_dir))
        held.keep(name)
    return docs
