import zlib

import numpy as np
import pandas as pd
import pytest

from tessera.llm import packing, queries

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def whole():
    model = tokenizers.Tokenizer.from_file(packing.tokenizer_path())
    return lambda t: [*model.encode(t or "", add_special_tokens=False).ids, 1]


ODD = [
    "é, ü. !, a., b.c, 1. 2,\n É.\n", "Ünd. ñ,ñ ,a .b ÉÈ,", "<|endoftext|>a b<|startoftext|>c", "<|ENDOFTEXT|> x", "I'll  Straße ΟΔΥΣΣΕΥΣ Σ İ é é ́x", "日本語 テスト。, x", "", None, " \n", "a" * 5000, "𝔘𝔫𝔦, €, x",
    "don't, won't. ###, %%%. a,b. c,, d.. e", "Привет, мир. ÖÄÜ, ×, ÷. ß,", "a\x00b \x00, \x00\x00", "x" * 64 + " " + "y" * 65 + " " + "abc" * 30 + ", é" + "é" * 40, ",", ".", ", .",
]


def test_tokens_are_the_tokenizers(whole, monkeypatch):
    coder = packing.WordTokenizer(packing.tokenizer_path())
    assert [x.tolist() for x in coder(ODD)] == [whole(t) for t in ODD]
    monkeypatch.setattr(packing, "_KEPT_WORDS", 3)
    for t in ODD * 2:
        assert coder([t])[0].tolist() == whole(t)


def check(out, texts, whole, window=2048):
    """Every id in one piece, windows gapless and full but for the last of each task."""
    for i, g in out.groupby("doc_id", dropna=False):
        g = g.sort_values("start")
        ids = whole(texts[i])
        assert (g.doc_tokens == len(ids)).all()
        assert g.start.tolist() == [0, *np.cumsum(g.length)[:-1].tolist()] and g.length.sum() == len(ids)
        for r in g.itertuples():
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    for _, g in out.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.offset.tolist() == [0, *np.cumsum(g.length)[:-1].tolist()] and g.length.sum() <= window


def test_query_over_the_whole_table(spark, sf, whole):
    out = queries.op8_packing(spark, sf).toPandas()
    docs = pd.read_parquet(f"{sf}/documents.parquet")
    assert set(out.doc_id) == set(docs.doc_id)
    check(out, dict(zip(docs.doc_id, docs.text)), whole)
    short = out.groupby("sequence_id").length.sum() < 2048
    assert short.sum() <= 4  # one open window a task


def brute_scores(docs, seed):
    n = len(docs)
    mean = sum(map(len, docs)) / n
    out = []
    for d in docs:
        s = 0.0
        for t in set(docs[seed].tolist()):
            tf, df = (d == t).sum(), sum((x == t).any() for x in docs)
            if tf:
                s += np.log1p((n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * len(d) / mean))
        out.append(s)
    return out


def test_index_scores_are_bm25():
    rng = np.random.default_rng(1)
    docs = [rng.zipf(1.3, rng.integers(1, 200)).clip(max=60000).astype(np.uint16) for _ in range(70)]
    index = packing.Index(docs, packing.statistics_of(docs))
    for seed in (0, 7, 69):
        np.testing.assert_allclose(index.scores(seed), brute_scores(docs, seed), rtol=1e-4)


def test_windows_hold_neighbours():
    rng = np.random.default_rng(2)
    topics = [rng.integers(100 + 1000 * k, 1000 + 1000 * k, 400).astype(np.uint16) for k in range(4)]
    docs = [rng.choice(topics[k % 4], 100) for k in range(40)]
    pieces = packing.pack_shard(docs, packing.Packer(500), packing.statistics_of(docs))
    windows = {}
    for doc, *_, window, _ in pieces:
        windows.setdefault(window, []).append(doc % 4)
    pure = sum(len(set(w)) == 1 for w in windows.values())
    assert pure >= len(windows) - 3


def plain_packer(docs, window):
    """The greedy rule step by step, over brute-force scores: (document, start, length, window, offset)."""
    free, out, at, used = list(range(len(docs))), [], 0, 0
    seed, start = None, 0
    while seed is not None or free:
        if seed is None:
            seed, start = free.pop(0), 0
        opened = at
        queue, scores = [(seed, start)], None
        seed = None
        while queue:
            doc, start = queue.pop(0)
            first = scores is None
            while start < len(docs[doc]):
                n = min(window - used, len(docs[doc]) - start)
                out.append((doc, start, n, at, used))
                start, used, opened = start + n, used + n, at
                if used == window:
                    at, used = at + 1, 0
                    if not first:
                        break
            if not first and at != opened:
                if start < len(docs[doc]):
                    seed = doc
                break
            if first:
                if at != opened:
                    break
                scores = brute_scores(docs, doc)
                ranked = sorted(free, key=lambda k: (-scores[k], k))
            if ranked:
                k = ranked.pop(0)
                free.remove(k)
                queue.append((k, 0))
    return out


def test_greedy_choice_against_a_plain_packer():
    rng = np.random.default_rng(4)
    docs = [rng.zipf(1.4, rng.integers(1, 300)).clip(max=60000).astype(np.uint16) for _ in range(50)]
    got = [(d, s, n, w, o) for d, s, n, _, w, o in packing.pack_shard(docs, packing.Packer(256), packing.statistics_of(docs))]
    assert got == plain_packer(docs, 256)


def test_neighbours_meet_in_a_shard(spark):
    """Recall of the whole table's BM25 neighbours: copies with edits, 40 of each of 50 texts, over many tasks."""
    rng = np.random.default_rng(6)
    rows = []
    for k in range(50):
        base = [f"{chr(97 + k % 26)}{''.join(chr(97 + c) for c in rng.integers(0, 26, 5))}" for _ in range(120)]
        for j in range(40):
            rows.append((len(rows), " ".join(w if rng.random() > 0.1 else "the" for w in base), k))
    rng.shuffle(rows)
    docs = spark.createDataFrame([(int(i), t) for i, t, _ in rows], "doc_id long, text string").repartition(16)
    family = {int(i): int(k) for i, _, k in rows}
    out = packing.packed(docs, shard=128).toPandas()
    per = [g.id.map(family).value_counts().iloc[0] / len(g) for _, g in out.groupby("sequence_id") if len(g) > 1]
    assert np.mean(per) >= 0.6  # a window of 2048 tokens holds about six documents of 50 families


def test_shards_are_bounded_in_tokens(spark, whole, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_TOKENS", 100)
    docs = spark.createDataFrame([(k, "word " * 90) for k in range(6)], "doc_id long, text string")
    out = packing.packed(docs).toPandas().rename(columns={"id": "doc_id"})
    check(out, {k: "word " * 90 for k in range(6)}, whole)


def test_edges_of_the_input(spark, whole):
    rows = [(k, t, 1) for k, t in enumerate(ODD)] + [(50, "word " * 9000, 2), (None, "null id", 3), (51, "same", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start int")
    out = packing.packed(docs, window=64, shard=3).toPandas().rename(columns={"id": "doc_id"})
    out["doc_id"] = out.doc_id.fillna(-1).astype(int)
    check(out, {(-1 if i is None else i): t for i, t, _ in rows}, whole, 64)
    twice = packing.packed(docs.where("doc_id = 51").union(docs.where("doc_id = 51")))
    assert twice.count() == 2 and packing.packed(docs.limit(0)).count() == 0
