"""Training-data pipeline over ``documents``: quality rules, near-duplicates, decontamination, PII, packing.

Each stage takes (spark, docs, sf_dir); all but the last return the columns of ``docs``. Rows with
nulls, repeated rows, empty texts and empty tables pass through with the results that each
operator's docstring defines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontam, minhash, packing, pii, quality
from tessera.llm._common import identity, materialize, own_columns, path_of, remove_path, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the rules reject; remove frequent lines from the others."""
    return quality.cleaned(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies (five-word Jaccard similarity of 0.8 or more): the one with the smallest id.

    Of rows that share that id, the one with the smallest identity stays, once. A group without
    any id keeps its row of smallest identity.
    """
    text = F.col("text").cast("string")
    slim = docs.select(F.col("doc_id").cast("long").alias("id"), identity("doc_id", "text").alias("key"), text.alias("text"))
    base, roots = minhash.groups(slim)
    roots = materialize(roots, "stage-components")
    named = base.join(roots, "body", "left").withColumn("root", F.coalesce("root", "body"))
    firsts = named.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("first"))
    firsts = materialize(firsts.select(F.col("first.key").alias("__k")), "stage-firsts")
    kept = docs.withColumn("__key", identity("doc_id", "text"))
    kept = kept.join(firsts, F.col("__key") == F.col("__k"), "left_semi")
    twice = materialize(base.groupBy("key").count().where("count > 1").join(firsts, F.col("key") == F.col("__k"), "left_semi").select(F.col("key").alias("__t")), "stage-twice")
    if twice.isEmpty():
        return kept.select(*own_columns(docs))
    again = kept.join(twice, F.col("__key") == F.col("__t"), "left_semi").dropDuplicates(["__key"])
    once = kept.join(twice, F.col("__key") == F.col("__t"), "left_anti")
    return once.unionByName(again).select(*own_columns(docs))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark passage."""
    return decontam.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data in the texts."""
    return pii.surrogated(docs).select(*own_columns(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into windows; one row per piece."""
    return packing.packed(docs).select(F.col("id").alias("doc_id"), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("surrogates", surrogates),
    ("pack", pack),
]

#: SQL has no XXH64 fingerprints, seeds or tokenizer; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each over a written table; a table goes once its successor is written."""
    docs, old = table(spark, sf_dir, "documents"), ""
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
        if old:
            remove_path(spark, old)
        old = path_of(docs)
    return STAGES[-1][1](spark, docs, sf_dir)
