"""Benchmark decontamination by spaced seeds.

A mask such as ``1101011`` reads only the token positions marked 1, so a passage with replaced
words still shares seeds with its source. Seeds of the test items and of the training texts are
joined on (mask, hash); each hit fixes a diagonal (an alignment without gaps), on which the
overlap is verified: some window of WINDOW aligned tokens (the whole item where it is shorter)
must agree in at least SIMILARITY of its positions. Items shorter than WINDOW have masks of their
own, one of which is free of any mismatches that this allows.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import identity, materialize, own_columns, small_batches

MASKS = ("11011011", "1110010111", "11001010111", "111111")
WINDOW, SIMILARITY, MIN_TOKENS = 13, 0.8, 5
#: Bytes of the seed index up to which it is sent to every task; beyond, seeds are shuffled. A seed
#: is 24 bytes, an item has about four a token, and a token of four bytes so makes about 100.
BROADCAST_BYTES, SEED_BYTES = 64 << 20, 24
#: Seed hits expanded together; a matter of memory only.
HITS = 1 << 20
_TOKEN = re.compile(r"\w+")
_GAP = max(WINDOW, *map(len, MASKS))
_STEP = np.uint64(0x9E3779B97F4A7C15)


def token_hash(token: str) -> int:
    return xxhash.xxh64_intdigest(token.encode("utf-8", "surrogatepass")) | 1


def tokens(text: str | None) -> list[str]:
    return _TOKEN.findall((text or "").lower())


def seeds(a: np.ndarray, mask: str) -> np.ndarray:
    """Seed hash at each start of ``a``; 0 where a token it reads is 0 (unknown or a gap)."""
    at = [k for k, c in enumerate(mask) if c == "1"]
    n = len(a) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, known = np.full(n, len(mask), np.uint64), np.ones(n, bool)
    for k in at:
        part = a[k : k + n]
        out = (out ^ part) * _STEP
        out ^= out >> np.uint64(29)
        known &= part != 0
    return np.where(known, out | np.uint64(1), np.uint64(0))


def short_masks(n: int) -> list[tuple[str, int]]:
    """(mask, position) for an item of ``n`` < WINDOW tokens.

    At most d tokens may differ; of d + 2 blocks each mask leaves out d, so that some mask reads
    none of the differing tokens. Below MIN_TOKENS no token may differ.
    """
    d = int(n * (1 - SIMILARITY) + 1e-9)
    bounds = [k * n // (d + 2) for k in range(d + 3)]
    out = []
    for left in itertools.combinations(range(d + 2), d):
        mask = "".join("0" if k in left else "1" for k in range(d + 2) for _ in range(bounds[k], bounds[k + 1]))
        out.append((mask.strip("0"), len(mask) - len(mask.lstrip("0"))))
    return out


def item_seeds(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions) of an item's seeds."""
    if 0 < len(a) < WINDOW:
        each = [(seeds(a[k : k + len(m)], m), k) for m, k in short_masks(len(a))]
    else:
        each = [(seeds(a, m), 0) for m in MASKS]
    h = np.concatenate([x for x, _ in each])
    return h[h != 0], np.concatenate([np.arange(len(x)) + k for x, k in each])[h != 0]


def agrees(doc: np.ndarray, item: np.ndarray, offset: int) -> int:
    """Matching tokens on the diagonal if a window of it passes, else 0."""
    lo, hi = max(0, -offset), min(len(item), len(doc) - offset)
    same = np.zeros(len(item), np.int64)
    same[lo:hi] = doc[offset + lo : offset + hi] == item[lo:hi]
    w = min(WINDOW, len(item))
    run = np.convolve(same, np.ones(w, np.int64), "valid") if len(item) else np.zeros(1)
    return int(same.sum()) if run.max() >= SIMILARITY * w - 1e-9 else 0


def _masks(lengths: set[int]) -> list[str]:
    """The masks that items of these lengths need."""
    return [*MASKS, *sorted({m for n in lengths if 0 < n < WINDOW for m, _ in short_masks(n)} - set(MASKS))]


def _slim(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    slim = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return slim.select(identity("id", "text").alias("key"), "id", "text")


def _by_broadcast(slim: DataFrame, items: list[tuple[int, str]]) -> DataFrame:
    """Pairs of the rows of ``slim`` and numbered items; the index goes to every task."""
    words = [tokens(t) for _, t in items]
    vocabulary = {w: token_hash(w) for ws in words for w in ws}
    arrays = [np.array([vocabulary[w] for w in ws], np.uint64) for ws in words]
    found = [item_seeds(a) for a in arrays]
    hashes = np.concatenate([np.zeros(0, np.uint64), *(h for h, _ in found)])
    places = np.stack((np.repeat(np.arange(len(found)), [len(h) for h, _ in found]), np.concatenate([np.zeros(0, np.int64), *(k for _, k in found)])), axis=1)
    order = np.argsort(hashes, kind="stable")
    sent = slim.sparkSession.sparkContext.broadcast((vocabulary, arrays, np.array([i for i, _ in items], np.int64), hashes[order], places[order], _masks(set(map(len, arrays)))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, items, names, hashes, places, masks = sent.value
        for batch in batches:
            parts, starts, at = [], [], 0
            for text in batch.column(2).to_pylist():
                ids = [known.get(w, 0) for w in tokens(text)]
                starts.append(at)
                parts.append(ids)
                at += len(ids) + _GAP
            flat, starts = np.zeros(at, np.uint64), np.array(starts, np.int64)
            for s, ids in zip(starts, parts, strict=True):
                flat[s : s + len(ids)] = ids
            best: dict[tuple[int, int], int] = {}
            # A text's hits are verified before the next text's are made; the diagonals of one text
            # and item are at most as many as their tokens.
            for doc, item, offset in _diagonals(flat, starts, hashes, places, masks):
                n = agrees(flat[starts[doc] : starts[doc] + len(parts[doc])], items[item], offset)
                if n > best.get((doc, item), 0):
                    best[doc, item] = n
            pairs = sorted(best)
            rows = pa.array([d for d, _ in pairs], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(rows), batch.column(1).take(rows), pa.array([names[i] for _, i in pairs], pa.int64()), pa.array([best[x] for x in pairs], pa.int64()), pa.array([len(items[i]) for _, i in pairs], pa.int64())],
                names=["key", "id", "item", "matched", "item_tokens"],
            )

    return slim.mapInArrow(run, "key string, id long, item long, matched long, item_tokens long")


def _diagonals(flat: np.ndarray, starts: np.ndarray, hashes: np.ndarray, places: np.ndarray, masks: list[str]) -> Iterator[tuple[int, int, int]]:
    """Distinct (text, item, offset) of a batch's seed hits, HITS hits at a time."""
    hits = []
    for mask in masks:
        h = seeds(flat, mask)
        p = np.flatnonzero(h)
        left, right = np.searchsorted(hashes, h[p]), np.searchsorted(hashes, h[p], "right")
        got = right > left
        hits.append((p[got], left[got], (right - left)[got]))
    p, left, n = (np.concatenate(x) for x in zip(*hits, strict=True))
    order = np.argsort(p, kind="stable")
    p, left, n = p[order], left[order], n[order]
    doc = np.searchsorted(starts, p, "right") - 1
    upto, at = np.cumsum(n), 0
    while at < len(p):
        # As many whole texts as stay below HITS, one at least.
        to = max(int(np.searchsorted(upto, (upto[at - 1] if at else 0) + HITS, "right")), at + 1)
        if to < len(p):
            first = int(np.searchsorted(doc, doc[to]))
            to = first if first > at else int(np.searchsorted(doc, doc[at], "right"))
        m = n[at:to]
        k = np.repeat(left[at:to], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
        d = np.repeat(doc[at:to], m)
        found = np.stack((d, places[k, 0], np.repeat(p[at:to], m) - starts[d] - places[k, 1]), axis=1)
        yield from map(tuple, np.unique(found, axis=0).tolist())
        at = to


def _by_shuffle(texts: DataFrame, items: DataFrame) -> DataFrame:
    """The same pairs where the items are too many to send: both sides' seeds are shuffled.

    A row of ``texts`` that is there twice has one key and gives a pair once.
    """

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(tokens(t)) for t in batch.column(1).to_pylist()], pa.int64())], names=["n"])

    short = items.select("item", "item_text").mapInArrow(lengths, "n long").where(F.col("n") < WINDOW).distinct()
    masks = _masks({r.n for r in short.collect()})  # WINDOW rows at most

    def emit(of_items: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for key, text in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                    a = np.array([token_hash(w) for w in tokens(text)], np.uint64)
                    if of_items:
                        h, k = item_seeds(a)
                    else:
                        each = [seeds(a, m) for m in masks]
                        h, k = np.concatenate(each), np.concatenate([np.arange(len(x)) for x in each])
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array([key.as_py()] * len(h), key.type), pa.array(k, pa.int64())], names=["hash", "key", "at"])

        return run

    left = texts.mapInArrow(emit(False), "hash long, key string, at long")
    right = items.select("item", "item_text").mapInArrow(emit(True), "hash long, key long, at long")
    right = materialize(right, "seeds").select("hash", F.col("key").alias("item"), F.col("at").alias("item_at"))
    hits = left.join(right, "hash").select("key", "item", (F.col("at") - F.col("item_at")).alias("offset")).distinct()
    hits = hits.join(texts.dropDuplicates(["key"]), "key").join(items, "item")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, item = ([np.array([token_hash(w) for w in tokens(t)], np.uint64) for t in batch.column(c).to_pylist()] for c in (2, 3))
            matched = [agrees(d, i, o) for d, i, o in zip(doc, item, batch.column(4).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(matched, pa.int64()), pa.array([len(i) for i in item], pa.int64())], names=["key", "item", "matched", "item_tokens"])

    found = hits.select("key", "item", "text", "item_text", "offset").mapInArrow(verify, "key string, item long, matched long, item_tokens long")
    return found.where("matched > 0").groupBy("key", "item").agg(F.max("matched").alias("matched"), F.max("item_tokens").alias("item_tokens"))


def overlaps(docs: DataFrame, tests: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(key, id, item_id, matched, item_tokens): each pair of a row of ``docs`` and an item it holds.

    Nulls: a null text has no tokens and holds nothing; a null id is carried. Items of fewer than
    MIN_TOKENS tokens match only in full. Repeated rows and items give repeated pairs. Empty
    tables give no rows. Other columns are not read. The result is the same whether the index is
    sent to the tasks or shuffled.
    """
    small_batches(docs.sparkSession)
    slim, items = _slim(docs, id_col, text_col), _slim(tests, item_col, item_text_col)
    distinct = items.where("text is not null").groupBy("text").agg(F.collect_list("id").alias("ids"), F.sum(F.col("id").isNull().cast("long")).alias("nameless"))
    numbered = materialize(distinct.select(F.monotonically_increasing_id().alias("item"), F.col("text").alias("item_text"), "ids", "nameless"), "items")
    size = numbered.agg(F.coalesce(F.sum(F.octet_length("item_text")), F.lit(0))).first()[0] * SEED_BYTES
    if size <= broadcast_bytes:
        found = _by_broadcast(slim, [(r["item"], r["item_text"]) for r in numbered.select("item", "item_text").collect()])
    else:
        found = materialize(_by_shuffle(slim.select("key", "text"), numbered.select("item", "item_text")), "pairs")
        times = slim.select("key", "id").join(found.select("key").distinct(), "key", "left_semi").groupBy("key", "id").count()
        found = found.join(times, "key").withColumn("count", F.explode(F.sequence(F.lit(1).cast("long"), "count"))).drop("count")
    names = numbered.select("item", F.explode(F.concat("ids", F.array_repeat(F.lit(None).cast("long"), F.col("nameless").cast("int")))).alias("item_id"))
    return found.join(names, "item").select("key", "id", "item_id", "matched", "item_tokens")


def decontaminated(docs: DataFrame, tests: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that hold a benchmark passage; columns as they were."""
    bad = materialize(overlaps(docs, tests, id_col, text_col).select(F.col("key").alias("__k")).distinct(), "leaks")
    out = docs.withColumn("__d", F.struct(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")))
    return out.join(bad, identity("__d.id", "__d.text") == F.col("__k"), "left_anti").select(*own_columns(docs))
