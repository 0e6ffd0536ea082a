"""Queries opN_<name> over the whole tables, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontam, langid, packing, pii, quality, secrets, sharding, simhash, urlrules, warc
from tessera.llm._common import table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), "item_id", "matched", "item_tokens")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.interleaved(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_urlrules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = urlrules.judged(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))
    return found.select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.surrogated(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "text", F.size("entities").cast("long").alias("n_entities"), F.array_join(F.transform("entities", lambda x: x["kind"]), ",").alias("kinds"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scanned(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == secrets.KINDS.index(k))).cast("long").alias(f"n_{k}")
    return found.select(
        F.col("id").alias("doc_id"),
        *map(count, ("assign", "access", "hex")),
        F.sha2(secrets.listed(F.col("base")), 256).alias("base_sha256"),
        secrets.listed(F.concat("base", "extra")).alias("spans"),
        F.size("extra").cast("long").alias("n_random"),
    )


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.round_trip(table(spark, sf_dir, "pages"))
    return found.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = packing.packed(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = langid.identified(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "held_out", "lang_pred", "score")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.verdicts(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_simhash, op2_decontam, op3_sharding, op4_urlrules, op5_pii, op6_secrets, op7_warc, op8_packing, op9_langid, op10_quality)}


def oracle_sql() -> dict[str, str]:
    return {"op7_warc": warc.SQL, "op10_quality": quality.SQL}
