"""Proportional stratified interleaving of rows into shards, in DataFrame expressions only.

Rows are shuffled by a seeded hash within each source and ranked; rank over the source's size is a
fraction in (0, 1); all rows are put in the order of their fractions, so that any stretch of that
order holds every source in proportion, and the order is cut into stretches of equal counts.

Neither ranking gathers a source in one task: rows fall into buckets by the leading bits of their
sort key, rows are numbered within a bucket, and bucket counts (a small table) give the offset of
each bucket. The number of buckets follows the number of rows, up to 2**MAX_BITS, so a bucket holds
about BUCKET_ROWS, and at 50 billion rows some 400,000 slim rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm._common import materialize

SHARDS, SEED, BUCKET_ROWS, MAX_BITS = 24, 7, 4096, 17


def ranked(rows: DataFrame, group: list[str], bucket: Column, order: list[Column], out: str) -> DataFrame:
    """``rows`` with ``out``: the 0-based position of each within its group.

    ``bucket`` must not fall as ``order`` rises. Rows of one (group, bucket) are sorted together;
    everything else is counting.
    """
    rows = rows.withColumn("__b", bucket)
    counts = rows.groupBy(*group, "__b").agg(F.count("*").alias("__c"))
    before = Window.partitionBy(*group).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("__o", F.coalesce(F.sum("__c").over(before), F.lit(0)))
    own = F.row_number().over(Window.partitionBy(*group, "__b").orderBy(*order)) - 1
    return rows.withColumn("__r", own).join(counts, [*group, "__b"]).withColumn(out, F.col("__o") + F.col("__r")).drop("__b", "__c", "__o", "__r")


def interleaved(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED) -> DataFrame:
    """(id, size, text_crc32, shard, slot): every row of ``docs`` in a shard, counts at most one apart.

    size: UTF-8 bytes of the text (null: none) plus 8; text_crc32 of a null text is that of no
    bytes. Nulls: a null source is a source of its own; null ids are shuffled by their place.
    Repeated rows are dealt each; among equal rows it does not matter which is which. An empty
    table gives no rows. Other columns are not read.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("")).alias("source"),
    )
    # Rows without an id have their place in the table instead, so that they never share a bucket.
    rows = rows.withColumn("h", F.shiftrightunsigned(F.xxhash64(F.lit(seed), "id", F.when(F.col("id").isNull(), F.monotonically_increasing_id())), 1))
    rows = materialize(rows, "rows")
    sources = rows.groupBy("source").agg(F.count("*").alias("n"))
    total = sources.agg(F.sum("n")).first()[0] or 0
    bits = min(MAX_BITS, max(1, math.ceil(math.log2(max(1, total / BUCKET_ROWS)))))
    order = [F.col("h"), F.col("id"), F.col("text_crc32"), F.col("size")]
    within = ranked(rows, ["source"], F.shiftright("h", 63 - bits), order, "rank")
    within = within.join(sources, "source").withColumn("at", (F.col("rank") + 0.5) / F.col("n"))
    within = materialize(within.drop("rank", "n"), "fractions").withColumn("all", F.lit(0))
    placed = ranked(within, ["all"], F.floor(F.col("at") * (1 << bits)), [F.col("at"), F.col("source"), *order], "place")
    # shard s holds the places from ceil(s * total / shards) on
    shard = F.expr(f"(place * {shards}) div {max(1, total)}")
    placed = placed.withColumn("shard", shard.cast("int"))
    first = F.expr(f"(shard * {total}L + {shards - 1}) div {shards}")
    return placed.select("id", "size", "text_crc32", "shard", (F.col("place") - first).alias("slot"))
