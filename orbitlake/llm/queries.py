"""Queries over the training-data operators, with production parameters, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import fim, langid, license_scan, lm_score, media, mixing, packing, parity_join, periodic, permutation_index, pii, warc, winnowing

HELD_OUT = "coalesce(crc32(cast(doc_id AS string)) % 4 = 2, false)"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pii_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda k: f"cast(size(filter(pii_base, x -> x.kind = '{k}')) AS bigint) AS n_{k}"
    return found.selectExpr("doc_id", *[count(k) for k in pii.KINDS[:4]], f"sha2({pii.listed('pii_base')}, 256) AS base_sha256", f"{pii.all_spans()} AS spans", "cast(size(pii_base) + size(pii_added) AS bigint) AS n_spans")


def language_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(f"doc_id IS NOT NULL AND NOT {HELD_OUT}"), key=F.col("doc_id"))
    return langid.identify(docs.select("doc_id", "text", F.expr(HELD_OUT).alias("held_out")), model, ["doc_id", "held_out"])


def packing_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def mixing_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.selectExpr("doc_id", "mix_source AS source", "mix_lang AS lang", "mix_topic AS topic", "cast(mix_words AS bigint) AS n_words", "mix_weight AS weight", "mix_p AS p", "mix_kept AS kept", "mix_miss AS miss")


def jaccard_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parity_join.parity_join(table(spark, sf_dir, "documents"))


def lm_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return lm_score.score(table(spark, sf_dir, "documents"), good)


def license_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def nearest_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return permutation_index.search(table(spark, sf_dir, "embeddings"))


def media_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digest(table(spark, sf_dir, "documents"))


def warc_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.round_trip(table(spark, sf_dir, "pages")).where("kind = 'record'")
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def decontamination_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.digest(winnowing.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def fim_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digest(fim.transform(table(spark, sf_dir, "documents")))


def periodic_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digest(periodic.find(periodic.planted(table(spark, sf_dir, "documents"))))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lm_score": lm_query,
    "op2_license": license_query,
    "op3_pii": pii_query,
    "op4_language": language_query,
    "op5_packing": packing_query,
    "op6_nearest": nearest_query,
    "op7_mixing": mixing_query,
    "op8_media": media_query,
    "op9_warc": warc_query,
    "op10_jaccard": jaccard_query,
    "op11_winnowing": decontamination_query,
    "op12_fim": fim_query,
    "op13_periodic": periodic_query,
}
ORACLE_SQL: dict[str, str] = {"op2_license": license_scan.sql(), "op11_winnowing": winnowing.sql(), "op12_fim": fim.sql()}
