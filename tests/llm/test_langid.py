import math
import random
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa

from tessera.llm import langid, queries


def brute_counts(train, order=langid.ORDER):
    counts = [{} for _ in range(order + 1)]
    for t in train:
        s = b" " * order + t.encode()
        for p in range(order, len(s)):
            for k in range(order + 1):
                seen = counts[k].setdefault(s[p - k : p], {})
                seen[s[p]] = seen.get(s[p], 0) + 1
    return counts


def brute_bits(counts, text, order=langid.ORDER):
    """Exact code length under frozen counts, by walking from the longest context down."""
    s = b" " * order + text.encode()
    bits = 0.0
    for p in range(order, len(s)):
        for k in range(order, -2, -1):
            if k < 0:
                bits += 8
                break
            seen = counts[k].get(s[p - k : p])
            if not seen:
                continue
            n, d = sum(seen.values()), len(seen)
            if s[p] in seen:
                bits -= math.log2(seen[s[p]] / (n + d))
                break
            bits -= math.log2(d / (n + d))
    return bits


def test_exact_code_lengths(monkeypatch):
    train = ["the cat sat on the mat", "a cat and a hat é", "zzz 123", "日本語のテキスト"]
    codes, starts, ends = langid.grams(pa.array(train))
    gram, count = np.unique(np.concatenate([codes[s:e] for s, e in zip(starts, ends)]), return_counts=True)
    made, counts = langid.tree(gram, count), brute_counts(train)
    texts = ["pad", "the hat", "qqq é!", "", "catcat 9", "日本 本", "Ж"]
    for chunk in (langid.CHUNK, 5):
        monkeypatch.setattr(langid, "CHUNK", chunk)
        got = langid.text_bits([made], pa.array(texts).slice(1))[:, 0]
        assert np.allclose(got, [brute_bits(counts, t) for t in texts[1:]], atol=1e-8)


def test_query_against_brute_force(spark, sf):
    """Predictions and scores of the whole query, recomputed from plain dictionaries."""
    out = queries.op9_langid(spark, sf).toPandas().set_index("doc_id")
    docs = pd.read_parquet(f"{sf}/documents.parquet").set_index("doc_id")
    learn = docs[np.array([zlib.crc32(str(i).encode()) % 4 != 2 for i in docs.index]) & docs.lang.notna() & (docs.text.fillna("") != "")]
    models = {n: brute_counts(learn.text[learn.lang == n]) for n in sorted(learn.lang.unique())}
    for i, text in docs.text.items():
        text = text or ""
        if not any(map(str.isalpha, text)):
            assert (out.lang_pred[i], out.score[i]) == ("und", 0)
        elif len(text) < 1500:
            bits = {n: brute_bits(m, text) for n, m in models.items()}
            best = min(bits.values())
            assert bits[out.lang_pred[i]] <= best + 1e-6
            assert abs(out.score[i] - 1 / sum(2 ** (best - b) for b in bits.values())) <= 1e-6


def test_twelve_languages_in_three_scripts(spark):
    """The order and the bytes are the same for any number of languages and scripts."""
    rng = random.Random(2)
    scripts = ["abcdefghijklmnopqrstuvwxyz", "абвгдежзийклмнопрстуфхцчшщъыьэюя", "αβγδεζηθικλμνξοπρστυφχψω"]
    docs, truth = [], {}
    for k in range(12):
        syllables = ["".join(rng.choices(scripts[k % 3], k=2)) for _ in range(40)]
        for j in range(40):
            text = " ".join("".join(rng.choices(syllables, k=rng.randrange(1, 4))) for _ in range(30))
            i = 100 * k + j
            held = zlib.crc32(str(i).encode()) % 4 == 2
            truth[i] = f"l{k:02}"
            docs.append((i, text, None if held else truth[i]))
    docs += [(5000, "x", "junk"), (5001, None, "empty"), (5002, "", "void")]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    out = {r.id: r.lang_pred for r in langid.identified(frame).collect()}
    assert all(out[i] == n for i, n in truth.items())
    assert not {"empty", "void"} & set(langid.trained(frame, "doc_id", "text", "lang"))


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    out = queries.op9_langid(spark, sf).toPandas().set_index("doc_id")
    docs = pd.read_parquet(f"{sf}/documents.parquet").set_index("doc_id")
    assert sorted(out.index) == sorted(docs.index)
    held = pd.Series({i: zlib.crc32(str(i).encode()) % 4 == 2 for i in docs.index})
    assert (out.held_out == held.reindex(out.index)).all()
    assert (out.lang_pred == docs.lang.reindex(out.index))[held.reindex(out.index)].mean() >= 0.99
    assert out.score.between(0, 1).all()


def test_edges_of_the_input(spark):
    rows = [(k, "the quick brown fox and the dog " * 3, "en", "x") for k in range(40)] + [(100 + k, "der schnelle braune fuchs und der hund " * 3, "de", "x") for k in range(40)]
    rows += [(500, None, "en", "x"), (501, "12345 !!", "en", "x"), (502, "", None, "x"), (None, "the dog", "en", "x"), (503, "the dog", None, "x"), (503, "the dog", None, "x"), (504, "é", "de", "x"), (505, "der hund " * 30000, None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    out = [(r.id, r.lang_pred, r.score) for r in langid.identified(docs).collect()]
    got = {i: p for i, p, _ in out}
    assert len(out) == len(rows) and got[500] == got[501] == got[502] == "und"
    assert got[None] == got[503] == "en" and got[505] == "de" and got[504] in ("en", "de")
    assert {s for i, p, s in out if p == "und"} == {0.0}
    assert langid.identified(docs.limit(0)).count() == 0
    assert {r.lang_pred for r in langid.identified(docs.where("doc_id >= 500 and lang is null")).collect()} == {"und"}


def test_the_sample_is_bounded(spark):
    docs = spark.range(4000).selectExpr("id AS doc_id", "'some words' AS text", "'en' AS lang")
    made = langid.trained(docs, "doc_id", "text", "lang", max_train=200)
    escape = made["en"][-1][3][0]  # d / (n + d) of the empty context, with 8 distinct bytes
    assert 100 * 10 < 8 * 2**escape - 8 < 320 * 10
