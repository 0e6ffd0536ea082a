import zlib

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.llm import queries, sharding


def test_query_over_the_whole_table(spark, sf):
    out = queries.op3_sharding(spark, sf).toPandas()
    docs = pd.read_parquet(f"{sf}/documents.parquet").set_index("doc_id")
    assert sorted(out.doc_id) == sorted(docs.index)
    for r in out.itertuples():
        raw = docs.text[r.doc_id].encode()
        assert (r.size, r.text_crc32) == (len(raw) + 8, zlib.crc32(raw))
    sizes = out.groupby("shard").size()
    assert list(sizes.index) == list(range(24)) and sizes.max() - sizes.min() <= 1
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in out.groupby("shard"))
    assert set(out.law) == {"rows"} and out.grown_shard.isna().all()


@pytest.mark.parametrize("rows", [4, 4096])
def test_every_shard_matches_the_mixture(spark, monkeypatch, rows):
    monkeypatch.setattr(sharding, "BUCKET_ROWS", rows)
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 7)).alias("source"))
    out = sharding.interleaved(docs, 10).join(docs, F.col("id") == F.col("doc_id")).toPandas()
    table = out.groupby(["shard", "source"]).size().unstack(fill_value=0)
    assert (table.max() - table.min()).max() <= table.shape[1] // 2  # a cut falls between interleaved sources
    assert out.groupby("shard").size().tolist() == [500] * 10


def test_buckets_do_not_change_the_result(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    one = sorted(map(tuple, sharding.interleaved(docs).collect()))
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 3)
    assert sorted(map(tuple, sharding.interleaved(docs).collect())) == one


def test_brute_force(spark):
    docs = spark.createDataFrame([(k, f"t{k}", f"s{k % 4}" if k % 5 else None) for k in range(97)], "doc_id long, text string, source string")
    hashed = docs.select("doc_id", "source", F.shiftrightunsigned(F.xxhash64(F.lit(sharding.SEED), "doc_id", F.lit(None).cast("long")), 1).alias("h")).collect()
    groups = {}
    for r in hashed:
        groups.setdefault("" if r.source is None else "s" + r.source, []).append((r.h, r.doc_id))
    places = sorted(((k + 0.5) / len(g), s, *x) for s, g in groups.items() for k, x in enumerate(sorted(g)))
    want = {x[3]: n * 8 // 97 for n, x in enumerate(places)}
    assert {r.id: r.shard for r in sharding.interleaved(docs, 8).collect()} == want


def test_edges_of_the_input(spark):
    rows = [(1, None, None, 9), (1, None, None, 9), (None, "a", "s", 1), (None, "b", "s", 1), (2, "é" * 50000, "s", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, shard int")
    out = sharding.interleaved(docs, 3).collect()
    assert len(out) == 5 and sorted(r.shard for r in out) == [0, 0, 1, 1, 2]
    assert {r["size"] for r in out if r.id == 2} == {100008} and {(r["size"], r.text_crc32) for r in out if r.id == 1} == {(8, 0)}
    assert sharding.interleaved(docs.limit(0)).count() == 0
