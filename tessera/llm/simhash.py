"""SimHash near-duplicates by a binary-trie self-join.

Fingerprints are stored implicitly as tries: a sorted run of 64-bit values is a trie in which
each node is a contiguous range. Two nodes are walked down together, bit by bit; a pair of
children on opposite bits costs one differing bit, and a pair whose bits exceed the budget is
pruned. With a budget of k bits, one of k+1 blocks of the fingerprint must agree, so the trie is
laid out k+1 times, each time with another block at its root where the budget is zero; those root
children (``bucket``) are the units that Spark deals to tasks. A bucket with more than
``node_limit`` fingerprints is split into sub-tries, and the pairs of sub-tries become the units.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm._common import connected_components, materialize, small_batches

SHINGLE, SEED, BUDGET, NODE_LIMIT = 4, 42, 4, 4096
#: Node pairs in flight in one step of the walk, and fingerprints walked together.
FRONTIER, CHUNK, LEAF = 1 << 20, 1 << 17, 16


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of one text; 0 for a null text or one without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    flat = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    stops = ends[shingle - 1 :] if len(words) >= shingle else ends[-1:]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(flat[a:b], SEED) for a, b in zip(starts[:n].tolist(), stops.tolist(), strict=True)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for k in range(0, n, 1 << 15):
        part = hashes[k : k + (1 << 15)]
        ones += np.unpackbits(part.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def majority(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Fingerprints of the runs of ``hashes`` that begin at ``starts``: bits set in over half of a run."""
    bits = np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, 64)
    ones = np.add.reduceat(bits, starts, axis=0, dtype=np.int64)
    size = np.diff(np.append(starts, len(hashes)))
    return np.packbits(ones * 2 > size[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, carry: list[str] | None = None) -> DataFrame:
    """(id, fp, and ``carry`` columns of longs): one row per row of ``docs``; fp is the fingerprint's bits as a signed long."""
    carry = carry or []
    small_batches(docs.sparkSession)
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), *carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([fingerprint(t, shingle) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64)), *batch.columns[2:]], names=["id", "fp", *carry])

    return slim.mapInArrow(run, ", ".join(f"{c} long" for c in ("id", "fp", *carry)))


def _join_labels(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Union the positions i[k] and j[k]; labels point at the smallest position of a set."""
    while True:
        a, b = labels[i], labels[j]
        apart = a != b
        if not apart.any():
            return
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = labels[labels]
            if (up == labels).all():
                break
            labels[:] = up


def trie_links(unit: np.ndarray, side: np.ndarray, value: np.ndarray, cross: np.ndarray, top: int, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within units: positions (i, j) that span each set of linked values.

    Units with ``cross`` join side 0 to side 1, others join side 0 to itself. ``top`` is the
    highest bit that may differ. Node pairs whose leaves already share one set are pruned too:
    they could add no new link to the components.
    """
    order = np.lexsort((value, side, unit))
    unit, side, value, cross = unit[order], side[order], value[order], cross[order]
    n = len(value)
    starts = np.flatnonzero(np.concatenate(([True], (unit[1:] != unit[:-1]) | (side[1:] != side[:-1])))) if n else np.zeros(0, np.int64)
    ends = np.append(starts[1:], n)
    own = ~cross[starts] if n else np.zeros(0, bool)
    pair = np.flatnonzero(~own[:-1] & (unit[starts[:-1]] == unit[starts[1:]])) if len(starts) > 1 else np.zeros(0, np.int64)
    first = np.concatenate((starts[own], starts[pair])), np.concatenate((ends[own], ends[pair]))
    second = np.concatenate((starts[own], starts[pair + 1])), np.concatenate((ends[own], ends[pair + 1]))
    ones = {b: np.concatenate(([0], np.cumsum((value >> np.uint64(b)) & np.uint64(1)).astype(np.int64))) for b in range(top, -1, -1)} if n else {}
    labels = np.arange(n)
    stack = [(top, *first, *second, np.zeros(len(first[0]), np.int8))]
    while stack:
        bit, alo, ahi, blo, bhi, bits = stack.pop()
        if len(alo) > FRONTIER:
            for k in range(0, len(alo), FRONTIER):
                stack.append((bit, *(x[k : k + FRONTIER] for x in (alo, ahi, blo, bhi, bits))))
            continue
        change = np.concatenate(([0], np.cumsum(labels[1:] != labels[:-1])))
        same = (labels[alo] == labels[blo]) & (change[alo] == change[ahi - 1]) & (change[blo] == change[bhi - 1])
        if same.any():
            alo, ahi, blo, bhi, bits = (x[~same] for x in (alo, ahi, blo, bhi, bits))
        if not len(alo):
            continue
        small = ((ahi - alo) * (bhi - blo) <= LEAF) | (bit < 0)
        if small.any():
            a, b, wide = alo[small], blo[small], (bhi - blo)[small]
            each = (ahi - alo)[small] * wide
            for lo in range(0, len(a), FRONTIER // LEAF):
                w, e = wide[lo : lo + FRONTIER // LEAF], each[lo : lo + FRONTIER // LEAF]
                k = np.arange(e.sum()) - np.repeat(np.cumsum(e) - e, e)
                w = np.repeat(w, e)
                i, j = np.repeat(a[lo : lo + FRONTIER // LEAF], e) + k // w, np.repeat(b[lo : lo + FRONTIER // LEAF], e) + k % w
                near = (np.bitwise_count(value[i] ^ value[j]) <= budget) & (i != j)
                _join_labels(labels, i[near], j[near])
            alo, ahi, blo, bhi, bits = (x[~small] for x in (alo, ahi, blo, bhi, bits))
        if not len(alo):
            continue
        p = ones[bit]
        amid, bmid = ahi - (p[ahi] - p[alo]), bhi - (p[bhi] - p[blo])
        self_pair = (alo == blo) & (ahi == bhi)
        kids = [(alo, amid, blo, bmid, bits, None), (amid, ahi, bmid, bhi, bits, None), (alo, amid, bmid, bhi, bits + 1, None), (amid, ahi, blo, bmid, bits + 1, ~self_pair)]
        parts = []
        for al, ah, bl, bh, d, keep in kids:
            ok = (ah > al) & (bh > bl) & (d <= budget)
            ok = ok if keep is None else ok & keep
            parts.append(tuple(x[ok] for x in (al, ah, bl, bh, d)))
        stack.append((bit - 1, *(np.concatenate(x) for x in zip(*parts, strict=True))))
    found = np.flatnonzero(labels != np.arange(n))
    return order[found], order[labels[found]]


def near_links(prints: DataFrame, budget: int = BUDGET, node_limit: int = NODE_LIMIT) -> DataFrame:
    """Links (a, b) that span every set of the distinct fingerprints ``prints(fp)`` within ``budget`` bits.

    Per unit of work at most one link less than it has fingerprints, never all pairs.
    """
    blocks = budget + 1
    width = 64 // blocks
    shifts = [k * width for k in range(blocks)]
    laid = prints.select("fp", F.explode(F.array(*[F.struct(F.lit(s).alias("s"), (F.shiftleft("fp", s).bitwiseOR(F.shiftrightunsigned("fp", 64 - s))).alias("v")) for s in shifts])).alias("x"))
    laid = laid.select("fp", F.col("x.s").alias("s"), F.col("x.v").alias("v")).withColumn("bucket", F.col("s") * F.lit(1 << 32) + F.shiftrightunsigned("v", 64 - width))
    laid = materialize(laid.drop("fp"), "tries")
    big = materialize(laid.groupBy("bucket").count().where(F.col("count") > node_limit).select("bucket", F.ceil(F.col("count") / node_limit).alias("g")), "big")
    units = laid.join(big, "bucket", "left").withColumn("g", F.coalesce("g", F.lit(1)))
    units = units.withColumn("i", F.pmod(F.xxhash64("v"), "g")).withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("g") - 1)))
    units = units.select("bucket", F.least("i", "j").alias("x"), F.greatest("i", "j").alias("y"), (F.col("i") > F.col("j")).alias("side"), "s", "v")
    units = units.repartition("bucket", "x", "y").sortWithinPartitions("bucket", "x", "y")
    top = 64 - width - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def walk(rows: pa.Table) -> pa.RecordBatch:
            bucket, x, y, side, s, v = (c.to_numpy() for c in rows.columns)
            unit = np.concatenate(([0], np.cumsum((bucket[1:] != bucket[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1]))))
            i, j = trie_links(unit, side.astype(np.int8), v.view(np.uint64), x != y, top, budget)
            turn = s.astype(np.uint64)
            back = (v.view(np.uint64) >> turn) | (v.view(np.uint64) << ((np.uint64(64) - turn) & np.uint64(63)))
            return pa.RecordBatch.from_arrays([pa.array(back[k].view(np.int64)) for k in (i, j)], names=["a", "b"])

        kept: pa.Table | None = None
        for batch in batches:
            kept = pa.Table.from_batches([batch]) if kept is None else pa.concat_tables([kept, pa.Table.from_batches([batch])])
            if kept.num_rows >= CHUNK:
                keys = [kept.column(k).to_numpy() for k in range(3)]
                cut = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in keys]))
                if len(cut):
                    yield walk(kept.slice(0, int(cut[-1]) + 1))
                    kept = kept.slice(int(cut[-1]) + 1)
        if kept is not None and kept.num_rows:
            yield walk(kept)

    return units.mapInArrow(run, T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())]))


def components(prints: DataFrame, budget: int = BUDGET) -> DataFrame:
    """(fp, root, component_id) for each distinct fingerprint of ``prints(id, fp)``.

    root names the component; component_id is its smallest id.
    """
    groups = materialize(prints.groupBy("fp").agg(F.min("id").alias("low")), "groups")
    roots = connected_components(near_links(groups.select("fp"), budget))
    roots = groups.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = roots.groupBy("root").agg(F.min("low").alias("component_id"))
    return roots.join(named, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, budget: int = BUDGET) -> DataFrame:
    """(id, fp, component_id) for every row of ``docs``.

    component_id is the smallest id reachable over links of at most ``budget`` differing bits.
    Nulls: a null text, like one without words, has fingerprint 0 and links like any other; a
    null id never is a component_id unless its whole component has none. Repeated rows stay.
    Texts shorter than the shingle are hashed whole. Other columns are not read.
    """
    base = materialize(fingerprints(docs, id_col, text_col, shingle), "prints")
    return base.join(materialize(components(base, budget), "components"), "fp").select("id", "fp", "component_id")
