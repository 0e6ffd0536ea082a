import itertools

import numpy as np
import pytest

from tessera.llm import decontam

ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma"
FILL = " ".join(f"filler{k}" for k in range(30))


def planted():
    words = ITEM.split()
    swapped = [w if k % 7 else f"other{k}" for k, w in enumerate(words)]
    half = [w if k % 2 else f"other{k}" for k, w in enumerate(words)]
    return {
        1: f"{FILL} {ITEM} {FILL}",
        2: f"{FILL} {' '.join(swapped)} {FILL}",
        3: FILL,
        4: f"{FILL} {' '.join(half)}",
        5: f"{ITEM.upper()}.",
        6: f"{FILL} {' '.join(words[:14])}",
        7: f"{FILL} {' '.join(words[:6])} {FILL}",
        8: "short item of five words",
        9: None,
        10: "",
    }


def brute(text, item):
    a, b = decontam.tokens(text), decontam.tokens(item)
    if len(b) < decontam.MIN_TOKENS:
        return False
    w = min(decontam.WINDOW, len(b))
    for offset in range(-len(b), len(a) + 1):
        same = [0 <= offset + k < len(a) and a[offset + k] == b[k] for k in range(len(b))]
        if any(sum(same[k : k + w]) >= decontam.SIMILARITY * w - 1e-9 for k in range(len(b) - w + 1)):
            return True
    return False


@pytest.mark.parametrize("size", [decontam.BROADCAST_BYTES, 0])
def test_planted_passages(spark, size):
    items = {1: ITEM, 2: "short item of five words", 3: "too short", 4: None}
    docs = spark.createDataFrame([(i, t, "x") for i, t in planted().items()], "doc_id long, text string, key string")
    tests = spark.createDataFrame(list(items.items()), "item_id long, text string")
    found = {(r.id, r.item_id) for r in decontam.overlaps(docs, tests, broadcast_bytes=size).collect()}
    assert found == {(i, j) for i, t in planted().items() for j, b in items.items() if brute(t, b)}
    assert {i for i, _ in found} == {1, 2, 5, 6, 8}
    kept = {r.doc_id for r in decontam.decontaminated(docs, tests).collect()}
    assert kept == {3, 4, 7, 9, 10}


def test_both_ways_agree(spark, sf):
    docs, tests = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    a, b = (sorted(map(tuple, decontam.overlaps(docs, tests, broadcast_bytes=n).collect())) for n in (decontam.BROADCAST_BYTES, 0))
    assert a == b and a
    texts = {r.doc_id: r.text for r in docs.collect()}
    items = {r.item_id: r.text for r in tests.collect()}
    assert all(brute(texts[i], items[j]) for _, i, j, _, _ in a)
    exact = {(i, j) for i, t in texts.items() for j, x in items.items() if x in t}
    assert exact <= {(i, j) for _, i, j, _, _ in a}


@pytest.mark.parametrize("size", [decontam.BROADCAST_BYTES, 0])
def test_edges_of_the_input(spark, size, monkeypatch):
    monkeypatch.setattr(decontam, "HITS", 7)
    docs = spark.createDataFrame([(1, ITEM, 1), (1, ITEM, 2), (None, ITEM, 3), (4, "w " * 100000, 4)], "doc_id long, text string, `id.x` int")
    tests = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    both = tests.union(tests).union(spark.createDataFrame([(None, ITEM), (None, ITEM), (7, None)], tests.schema))
    assert decontam.overlaps(docs, tests, broadcast_bytes=size).count() == 3
    found = [(r.id, r.item_id) for r in decontam.overlaps(docs, both, broadcast_bytes=size).collect()]
    assert sorted(found, key=str) == sorted([(i, j) for i in (1, 1, None) for j in (1, 1, None, None)], key=str)
    assert decontam.overlaps(docs, tests.limit(0)).count() == 0
    assert decontam.overlaps(docs.limit(0), tests).count() == 0
    out = decontam.decontaminated(docs, tests)
    assert out.columns == docs.columns and [r.doc_id for r in out.collect()] == [4]


@pytest.mark.parametrize("size", [decontam.BROADCAST_BYTES, 0])
def test_random_substitutions_at_every_length(spark, size):
    """Every passage that the rule admits is found, whatever is replaced in it."""
    rng = np.random.default_rng(11)
    items = {n: [f"i{n}w{k}" for k in range(n)] for n in range(5, 41)}
    docs, of = [], []
    for n, words in items.items():
        for share in (0.1, 0.2, 0.3):
            for _ in range(12):
                swap = rng.random(n) < share
                of.append(n)
                docs.append((len(docs), " ".join([FILL, *(f"x{k}" if s else w for k, (w, s) in enumerate(zip(words, swap))), FILL])))
    texts = {n: " ".join(w) for n, w in items.items()}
    frame, tests = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(list(texts.items()), "item_id long, text string")
    found = {(r.id, r.item_id) for r in decontam.overlaps(frame, tests, broadcast_bytes=size).collect()}
    want = {(i, of[i]) for i, t in docs if brute(t, texts[of[i]])}  # no token is in two items
    assert found == want and len(want) > 600


def test_masks_ignore_positions():
    a = np.arange(1, 30, dtype=np.uint64)
    b = a.copy()
    b[2] = 999
    assert decontam.seeds(a, "110111")[0] == decontam.seeds(b, "110111")[0]
    assert decontam.seeds(a, "111111")[0] != decontam.seeds(b, "111111")[0]


@pytest.mark.parametrize("size", [decontam.BROADCAST_BYTES, 0])
def test_short_items_with_replaced_words(spark, size):
    words = [f"tok{k}" for k in range(12)]
    items = {n: " ".join(f"{w}n{n}" for w in words[:n]) for n in range(1, 13)}
    docs, want = [], set()
    for n, item in items.items():
        for d in range(3):
            for at in itertools.combinations(range(n), d):
                text = " ".join(f"other{k}" if k in at else w for k, w in enumerate(item.split()))
                for text in (text, f"{FILL} {text} {FILL}"):
                    docs.append((len(docs), text))
                    if d <= n / 5:
                        want.add((docs[-1][0], n))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    tests = spark.createDataFrame(list(items.items()), "item_id long, text string")
    assert {(r.id, r.item_id) for r in decontam.overlaps(frame, tests, broadcast_bytes=size).collect()} == want
