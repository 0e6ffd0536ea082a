import numpy as np
import pandas as pd
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import queries, simhash
from tessera.llm._common import connected_components

WHITE = " \t\n\x0b\x0c\r"


def brute_fingerprint(text):
    words, word = [], ""
    for c in (text or "") + " ":
        if c in WHITE:
            words, word = (words + [word] if word else words), ""
        else:
            word += c.lower() if "A" <= c <= "Z" else c
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, ids):
    group = list(range(len(prints)))

    def find(k):
        while group[k] != k:
            k = group[k]
        return k

    for a in range(len(prints)):
        for b in range(a):
            if bin(prints[a] ^ prints[b]).count("1") <= 4:
                group[find(a)] = find(b)
    low = {}
    for k in range(len(prints)):
        if ids[k] is not None:
            low[find(k)] = min(low.get(find(k), ids[k]), ids[k])
    return [low.get(find(k)) for k in range(len(prints))]


@given(st.text(alphabet="aAbÉ \n\t\x0b. ", max_size=60))
@settings(max_examples=200, deadline=None)
def test_fingerprint(text):
    assert simhash.fingerprint(text) == brute_fingerprint(text)


@given(st.lists(st.integers(0, 2**64 - 1), max_size=40), st.integers(0, 2**64 - 1))
@settings(max_examples=50, deadline=None)
def test_trie_links_give_the_components(values, centre):
    rng = np.random.default_rng(len(values))
    near = [centre ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False)) for _ in range(60)]
    values = sorted({*values, *near})
    v = np.array(values, np.uint64)
    n = len(v)
    # One unit whose root has no exact block: every bit may differ.
    i, j = simhash.trie_links(np.zeros(n, int), np.zeros(n, np.int8), v, np.zeros(n, bool), 63, 4)
    group = list(range(n))

    def find(k):
        while group[k] != k:
            k = group[k]
        return k

    for a, b in zip(i.tolist(), j.tolist()):
        assert bin(values[a] ^ values[b]).count("1") <= 4 * n
        group[find(a)] = find(b)
    want = brute_components(values, list(range(n)))
    got = {}
    for k in range(n):
        got.setdefault(find(k), []).append(k)
    assert sorted(map(tuple, got.values())) == sorted(tuple(k for k in range(n) if want[k] == w) for w in set(want))


def test_query_over_the_whole_table(spark, sf):
    out = queries.op1_simhash(spark, sf).toPandas()
    docs = pd.read_parquet(f"{sf}/documents.parquet")
    text = dict(zip(docs.doc_id, docs.text))
    assert sorted(out.doc_id) == sorted(docs.doc_id)
    prints = [brute_fingerprint(text[i]) for i in out.doc_id]
    assert [int(x, 16) for x in out.fingerprint] == prints
    assert out.component_id.tolist() == brute_components(prints, out.doc_id.tolist())


@pytest.mark.parametrize("limit", [4096, 5])
def test_large_buckets_split_without_loss(spark, limit):
    rng = np.random.default_rng(3)
    centre = 0x0123456789ABCDEF
    values = {centre}
    while len(values) < 60:
        values.add(centre ^ sum(1 << int(b) for b in rng.choice(64, 3, replace=False)))
    values = sorted(values)
    df = spark.createDataFrame([(int(np.uint64(v).astype(np.int64)),) for v in values], "fp long")
    links = simhash.near_links(df, node_limit=limit)
    rows = connected_components(links).toPandas()
    signed = [int(np.uint64(v).astype(np.int64)) for v in values]
    root = dict(zip(rows.node, rows.root))
    got = {}
    for s in signed:
        got.setdefault(root.get(s, s), []).append(s)
    want = {}
    for s, c in zip(signed, brute_components(values, signed)):
        want.setdefault(c, []).append(s)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))
    assert links.count() <= 5 * len(values) * 15


def test_edges_of_the_input(spark):
    rows = [(5, None, 1), (3, "", 1), (None, "one two", 1), (9, "one two", 2), (9, "one two", 2), (1, "x " * 60000, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    out = {(r.id, r.fp): r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert out[5, 0] == 3 and out[3, 0] == 3
    assert {c for (i, f), c in out.items() if i in (None, 9)} == {9}
    assert simhash.near_duplicates(docs).count() == 6
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_components_of_chains(spark):
    edges = [(k, k + 1) for k in range(50)] + [(100, 101), (7, 7)]
    rows = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {(r.node, r.root) for r in rows} == {(k, 0) for k in range(51)} | {(100, 100), (101, 100)}
