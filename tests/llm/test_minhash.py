import itertools

import corpus_pipeline
import numpy as np
import pytest

from tessera.llm import minhash


def brute_set(text):
    words = (text or "").lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def kept(texts):
    """Smallest position of each component over pairs of Jaccard similarity 0.8 or more."""
    sets, group = [brute_set(t) for t in texts], list(range(len(texts)))
    for a, b in itertools.combinations(range(len(sets)), 2):
        if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) and group[a] != group[b]:
            old, new = max(group[a], group[b]), min(group[a], group[b])
            group = [new if g == old else g for g in group]
    return set(group)


def near_texts():
    rng = np.random.default_rng(5)
    texts = []
    for family in range(12):
        base = [f"w{family}x{k}" for k in range(120)]
        for edits in (0, 1, 2, 3, 4, 6, 9):
            words = list(base)
            for k in rng.choice(120, edits, replace=False):
                words[k] = f"e{family}y{edits}z{k}"
            texts.append(" ".join(words))
    return texts + ["short text", "short text", "", None]


@pytest.mark.parametrize("part", [minhash.PART, 4])
def test_near_copies_go_and_others_stay(spark, monkeypatch, part):
    monkeypatch.setattr(minhash, "PART", part)
    texts = near_texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()} == kept(texts)


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = sorted(docs.collect(), key=lambda r: r.doc_id)
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()} == {rows[k].doc_id for k in kept([r.text for r in rows])}


def test_fingerprints_are_the_majority_of_bits():
    rng = np.random.default_rng(1)
    sets = [rng.integers(0, 1 << 64, n, np.uint64) for n in (1, 2, 7, 50)]
    want = [sum((sum(int(h) >> b & 1 for h in s) * 2 > len(s)) << b for b in range(64)) for s in sets]
    assert minhash.minhashes(sets)[1].tolist() == want
