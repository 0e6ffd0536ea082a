import corpus_pipeline
from tessera.llm import decontam, quality


def docs_of(spark):
    words = lambda tag, n=80: " ".join(f"{tag}{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(n))
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi"
    rows = [(1, words("one"), "en", "s", 1), (2, words("one"), "en", "s", 1), (3, words("two"), "en", "s", 1), (4, "too short", "en", "s", 1)]
    rows += [(5, f"{words('five')} {item} end", "en", "s", 1), (6, f"{words('six')} call +1 (988) 555-2485 now", "en", "s", 1), (7, None, None, None, None), (None, words("null"), None, None, 1)]
    rows += [(3, words("two"), "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return docs, spark.createDataFrame([(1, item)], "item_id long, text string")


def test_stages_in_order(spark, tmp_path):
    docs, tests = docs_of(spark)
    tests.write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "near_duplicates", "decontaminate", "surrogates", "pack"]
    left, at = {}, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, str(tmp_path))
        assert at.columns == docs.columns
        at.write.parquet(f"{tmp_path}/{name}")
        at = spark.read.parquet(f"{tmp_path}/{name}")
        left[name] = sorted((r.doc_id or 0) for r in at.collect())
    assert left["quality_rules"] == [0, 1, 2, 3, 3, 5, 6]
    assert left["near_duplicates"] == [0, 1, 3, 5, 6]
    assert left["decontaminate"] == [0, 1, 3, 6]
    assert left["surrogates"] == [0, 1, 3, 6]
    assert not at.where("text like '%555-2485%'").count()
    assert sorted((r.doc_id or 0) for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").distinct().collect()) == [0, 1, 3, 6]


def test_against_a_plain_walk(spark, sf):
    """The stages on real rows against brute force over their own inputs."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    one = corpus_pipeline.quality_rules(spark, docs, sf).toPandas()
    failed = {r.doc_id for r in docs.collect() if (m := quality.measure(r.text))[0] < 50 or 2 * m[4] > m[0]}
    assert not failed & set(one.doc_id) and len(one) >= 0.95 * (docs.count() - len(failed))
    at = spark.createDataFrame(one, docs.schema)
    two = corpus_pipeline.near_duplicates(spark, at, sf)
    from test_minhash import kept

    rows = one.sort_values("doc_id").reset_index(drop=True)
    keep = {int(rows.doc_id[k]) for k in kept(rows.text.tolist())}
    assert {r.doc_id for r in two.collect()} == keep
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    three = {r.doc_id for r in corpus_pipeline.decontaminate(spark, two, sf).collect()}
    assert all(not any(x in r.text for x in items) for r in two.collect() if r.doc_id in three)
    assert keep - three == {r.id for r in decontam.overlaps(two, spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}


def test_empty_table(spark, tmp_path):
    docs, tests = docs_of(spark)
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    tests.limit(0).write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
