"""Nodes that meet in a neighbour list: counted by pair, or closed to triangles.

The pairs are many times the lists, so they are never shuffled. Nodes are dealt to blocks, and each
two blocks make one task, which gets those two parts of every list and expands them in arrays; every
pair has one task. A list is sent as often as there are blocks, or as it has members if these are
fewer. The blocks grow with the root of the pairs, so that a task's share stays as it is, and a hub's
list is spread over all tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pairs of a task, on average; sorted at once.
PAIRS = 8_000_000
#: Pairs expanded and rows returned at once.
STEP = 1 << 20
#: What a row's ``x`` is for: pairs with ``y``, pairs within itself, neighbours of ``v`` to look up.
ACROSS, WITHIN, EDGES = 0, 1, 2


def blocks(df: DataFrame, pairs: int) -> int:
    """Blocks of nodes for so many pairs; a few tasks a core at least, if each has a million."""
    parts = max(1, -(-pairs // PAIRS), min(df.sparkSession.sparkContext.defaultParallelism, pairs // 1_000_000))
    return math.ceil((math.sqrt(8 * parts + 1) - 1) / 2)


def common(near: DataFrame, k: int) -> DataFrame:
    """(a, b, common, jaccard) with a < b of ``near`` (v, u, n): u is a neighbour of v, n has u's count of neighbours."""
    return _deal(near, k, False).mapInArrow(_count, "a string, b string, common long, jaccard double")


def triangles(near: DataFrame, k: int) -> DataFrame:
    """(a, b, c, w) with a < b < c of ``near`` (v, u, n): each edge once, n its weight, w the product of three."""
    return _deal(near, k, True).mapInArrow(_close, "a string, b string, c string, w double")


def _deal(near: DataFrame, k: int, edges: bool) -> DataFrame:
    """(v, x, xn, y, yn, kind): parts of lists, each partition having those of one pair of blocks."""
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(k)).cast("int")
    tasks = k * (k + 1) // 2  # of both sides: what a task sends is then held in memory, not spilled
    lists = near.repartition(tasks, "v").groupBy("v", block("u").alias("i")).agg(F.collect_list(F.struct("u", "n")).alias("s"))
    lists = lists.groupBy("v").agg(F.collect_list(F.struct("i", F.col("s.u").alias("u"), F.col("s.n").alias("n"))).alias("parts"))
    x = lists.select("v", "parts", F.explode("parts").alias("x"))
    others = F.filter("parts", lambda y: y["i"] >= F.col("x.i"))
    if edges:
        others = F.concat(others, F.array(F.lit(None)))
    rows = x.select("v", "x", F.explode(others).alias("y"))
    kind = F.when(F.col("y").isNull(), EDGES).when(F.col("x.i") == F.col("y.i"), WITHIN).otherwise(ACROSS)
    rows = rows.withColumns({"kind": kind, "j": F.coalesce("y.i", block("v"))})
    low, high = F.least("x.i", "j"), F.greatest("x.i", "j")
    apart = lambda c: F.when(F.col("kind") == ACROSS, F.col(c))
    rows = rows.select(
        (high * (high + 1) / 2 + low).cast("int").alias("task"),
        (F.col("v") if edges else F.lit(None).cast("string")).alias("v"),
        F.col("x.u").alias("x"),
        F.col("x.n").alias("xn"),
        apart("y.u").alias("y"),
        apart("y.n").alias("yn"),
        "kind",
    )
    return rows.repartitionById(tasks, "task").drop("task")


class _Lists:
    """A partition's rows as flat arrays; names are numbered in their order."""

    def __init__(self, batches: list[pa.RecordBatch]):
        t = pa.Table.from_batches(batches)
        flat = [pc.list_flatten(t["x"]), pc.list_flatten(t["y"]), t["v"].drop_null()]
        coded = pa.chunked_array([c for part in flat for c in part.chunks], pa.string()).dictionary_encode().unify_dictionaries()
        names = coded.chunk(0).dictionary
        order = pc.sort_indices(names)
        rank = np.empty(len(names), np.int64)
        rank[order.to_numpy()] = np.arange(len(names))
        self.names, self.size = names.take(order), len(names)
        #: Numbers of the members of all x and then all y, and of the rows' v.
        codes = rank[np.concatenate([c.indices.to_numpy() for c in coded.chunks])]
        members = len(flat[0]) + len(flat[1])
        self.codes, self.v = codes[:members], codes[members:]
        self.n = np.concatenate([pc.list_flatten(t[c]).to_numpy() for c in ("xn", "yn")])
        self.kind = t["kind"].to_numpy()
        self.nx, self.ny = (pc.fill_null(pc.list_value_length(t[c]), 0).to_numpy().astype(np.int64) for c in ("x", "y"))

    def pairs(self) -> tuple[int, Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
        """How many pairs there are, and (row, x, y) of them in parts, x and y being positions in ``codes``."""
        row = np.repeat(np.arange(len(self.nx)), self.nx)
        at, end = np.arange(len(row)), np.cumsum(self.nx)[row]
        kind = self.kind[row]
        start = np.where(kind == WITHIN, at + 1, len(row) + (np.cumsum(self.ny) - self.ny)[row])
        length = np.where(kind == WITHIN, end - at - 1, np.where(kind == ACROSS, self.ny[row], 0))
        done = np.cumsum(length)

        def parts() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
            lo = 0
            while lo < len(row):
                hi = max(lo + 1, int(np.searchsorted(done, (done[lo - 1] if lo else 0) + STEP, "right")))
                n = length[lo:hi]
                y = np.arange(n.sum()) + np.repeat(start[lo:hi] - np.cumsum(n) + n, n)
                yield np.repeat(row[lo:hi], n), np.repeat(at[lo:hi], n), y
                lo = hi

        return int(done[-1]) if len(done) else 0, parts()

    def keys(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.minimum(a, b) * self.size + np.maximum(a, b)


def _runs(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, in order, and their counts."""
    if counts is None:
        keys.sort()
    else:
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.diff(first, append=len(keys)) if counts is None else np.add.reduceat(counts, first)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    lists = _Lists(held)
    held.clear()
    degree = np.zeros(lists.size, np.int64)
    degree[lists.codes] = lists.n
    total, parts = lists.pairs()
    if not total:
        return
    room, used, sums = np.empty(min(total, 2 * PAIRS), np.int64), 0, None
    for _, x, y in parts:
        keys = lists.keys(lists.codes[x], lists.codes[y])
        while len(keys):
            take = keys[: len(room) - used]
            room[used : used + len(take)] = take
            used, keys = used + len(take), keys[len(take) :]
            if used == len(room):
                sums, used = _added(sums, _runs(room)), 0
    if used:
        sums = _added(sums, _runs(room[:used]))
    del room, parts
    for lo in range(0, len(sums[0]), STEP // 8):
        keys, n = (z[lo : lo + STEP // 8] for z in sums)
        a, b = np.divmod(keys, lists.size)
        share = n / (degree[a] + degree[b] - n)
        yield pa.record_batch([lists.names.take(pa.array(a)), lists.names.take(pa.array(b)), pa.array(n), pa.array(share)], names=["a", "b", "common", "jaccard"])


def _added(sums: tuple[np.ndarray, np.ndarray] | None, more: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return more if sums is None else _runs(*(np.concatenate(z) for z in zip(sums, more)))


def _close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    lists = _Lists(held)
    held.clear()
    of = np.repeat(np.arange(len(lists.nx)), lists.nx)
    at = np.flatnonzero(lists.kind[of] == EDGES)
    if not len(at):
        return
    edges = lists.keys(lists.codes[at], lists.v[of[at]])
    order = np.argsort(edges)
    edges, weight = edges[order], lists.n[at][order]
    # Most pairs are no edge: a table of marks at hashes of the edges takes them out before the search.
    shift = np.uint64(64 - min(24, max(10, 4 + int(len(edges)).bit_length())))
    mix = lambda keys: (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> shift
    marks = np.zeros(1 << (64 - int(shift)), bool)
    marks[mix(edges)] = True
    for row, x, y in lists.pairs()[1]:
        keys = lists.keys(lists.codes[x], lists.codes[y])
        hit = np.flatnonzero(marks[mix(keys)])
        found = np.minimum(np.searchsorted(edges, keys[hit]), len(edges) - 1)
        right = edges[found] == keys[hit]
        hit, found = hit[right], found[right]
        if len(hit):
            x, y = x[hit], y[hit]
            abc = np.sort(np.stack([lists.v[row[hit]], lists.codes[x], lists.codes[y]]), axis=0)
            w = lists.n[x] * lists.n[y] * weight[found]
            for lo in range(0, len(w), STEP // 8):
                part = slice(lo, lo + STEP // 8)
                yield pa.record_batch([*(lists.names.take(pa.array(z[part])) for z in abc), pa.array(w[part])], names=["a", "b", "c", "w"])
