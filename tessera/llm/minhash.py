"""Near copies by exact Jaccard similarity of word shingles: the pipeline's use of the SimHash operator.

SimHash fingerprints of the shingle sets are joined by the binary-trie self-join of ``simhash``. Its
budget of 4 of 64 bits finds copies with few edits, but pairs near the stated similarity differ by
some 10 bits, where no trie can prune; so candidates come from a second source too: min-hashes of
each set are cut into bands; texts that share a band meet in one unit of work, where those whose
min-hashes agree in AGREE places or more are linked. Each component of all these rough links is then a unit in which the shingle sets themselves are compared, so that
every final link has a Jaccard similarity of SIMILARITY or more. A pair at 0.8 exactly shares no
band with a chance of 3 in 100,000; more similar pairs are missed less often. Large units are split
and the pairs of their parts become the units; none is capped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import simhash
from tessera.llm._common import connected_components, materialize, small_batches

SHINGLE, SIMILARITY, SEED = 5, 0.8, 42
BANDS, ROWS, AGREE = 20, 4, 46
#: Texts of one part of a unit, shingles of one part, and shingles whose min-hashes are taken together.
PART, PART_SHINGLES, TOGETHER = 1024, 1 << 20, 1 << 15
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.random.default_rng(SEED).integers(0, 1 << 64, (2, BANDS * ROWS), np.uint64)
_XOR, _TIMES = _MIX[0], _MIX[1] | np.uint64(1)


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles; a shorter text is one shingle, one without words has none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    flat = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    stops = ends[size - 1 :] if len(words) >= size else ends[-1:]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(flat[a:b], SEED) for a, b in zip(starts[: len(stops)].tolist(), stops.tolist(), strict=True)), np.uint64, len(stops)))


def minhashes(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Min-hashes of non-empty sets, a row each, and their SimHash fingerprints."""
    out, fps = np.zeros((len(sets), BANDS * ROWS), np.uint64), np.zeros(len(sets), np.uint64)
    at = 0
    while at < len(sets):
        to, n = at, 0
        while to < len(sets) and (to == at or n + len(sets[to]) <= TOGETHER):
            n += len(sets[to])
            to += 1
        flat = np.concatenate(sets[at:to])
        starts = np.concatenate(([0], np.cumsum([len(s) for s in sets[at : to - 1]], dtype=np.int64))).astype(np.int64)
        for k in range(BANDS * ROWS):
            out[at:to, k] = np.minimum.reduceat((flat ^ _XOR[k]) * _TIMES[k], starts)
        fps[at:to] = simhash.majority(flat, starts)
        at = to
    return out, fps


def bands_of(mins: np.ndarray) -> np.ndarray:
    out = np.tile(np.arange(BANDS, dtype=np.uint64) * _STEP, (len(mins), 1))
    for k in range(ROWS):
        out = (out ^ mins[:, k::ROWS]) * _STEP
        out ^= out >> np.uint64(29)
    return out


def prints(docs: DataFrame) -> DataFrame:
    """(id, key, body, n, fp, bands, sig) for each row of ``docs(id, key, text)``: body names the shingle set, n is its size."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t) for t in batch.column(2).to_pylist()]
            mins, fps = minhashes([s for s in sets if len(s)])
            full, bands, sig = iter(range(len(mins))), bands_of(mins).view(np.int64), mins.astype(np.uint8)
            rows = [next(full) if len(s) else None for s in sets]
            body = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(body), pa.array([len(s) for s in sets], pa.int64()), pa.array([None if r is None else fps.view(np.int64)[r] for r in rows], pa.int64()), pa.array([None if r is None else bands[r] for r in rows], pa.list_(pa.int64())), pa.array([None if r is None else sig[r].tobytes() for r in rows], pa.binary())],
                names=["id", "key", "body", "n", "fp", "bands", "sig"],
            )

    return docs.select("id", "key", "text").mapInArrow(run, "id long, key string, body long, n long, fp long, bands array<long>, sig binary")


def forest(n: int, near: Callable[[int, np.ndarray], np.ndarray]) -> tuple[list[int], list[int]]:
    """Links that span each component of 0 .. n-1; near(i, rest) says which of ``rest`` link to i."""
    rest, a, b = np.arange(n), [], []
    queue: list[int] = []
    while len(rest):
        if not queue:
            queue, rest = [int(rest[0])], rest[1:]
        i = queue.pop()
        hit = near(i, rest) if len(rest) else np.zeros(0, bool)
        found = rest[hit].tolist()
        a += [i] * len(found)
        b += found
        queue += found
        rest = rest[~hit]
    return a, b


def alike(sig: list[bytes]) -> tuple[list[int], list[int]]:
    """Rough links of a unit."""
    m = np.frombuffer(b"".join(sig), np.uint8).reshape(len(sig), -1)
    return forest(len(m), lambda i, rest: (m[rest] == m[i]).sum(axis=1) >= AGREE)


def similar(sets: list[np.ndarray]) -> tuple[list[int], list[int]]:
    """Exact links of a unit: Jaccard similarity of SIMILARITY or more."""
    size = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(len(sets)), size)
    word = np.unique(np.concatenate(sets), return_inverse=True)[1]
    order = np.argsort(word, kind="stable")
    posts = owner[order]
    first = np.concatenate(([0], np.cumsum(np.bincount(word))))
    begin = np.concatenate(([0], np.cumsum(size)))

    def near(i: int, rest: np.ndarray) -> np.ndarray:
        w = word[begin[i] : begin[i + 1]]
        lo, n = first[w], first[w + 1] - first[w]
        k = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
        both = np.bincount(posts[k], minlength=len(sets))[rest]
        return both >= SIMILARITY * (size[rest] + size[i] - both) - 1e-9

    return forest(len(sets), near)


def _in_units(rows: DataFrame, parts: DataFrame, unit: str, payload: str, links: Callable) -> DataFrame:
    """Links (a, b) of bodies found within each unit of ``rows(unit, body, payload)``.

    ``parts(unit, g)`` names the units to be split into g parts.
    """
    laid = rows.join(parts, unit, "left").withColumn("g", F.coalesce("g", F.lit(1).cast("long")))
    laid = laid.withColumn("i", F.pmod(F.xxhash64("body"), "g")).withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("g") - 1)))
    # The pair of a part with itself is covered by its pairs with others.
    laid = laid.where((F.col("i") != F.col("j")) | (F.col("g") == 1))
    laid = laid.select(F.col(unit).alias("unit"), F.least("i", "j").alias("x"), F.greatest("i", "j").alias("y"), "body", payload)
    laid = laid.repartition("unit", "x", "y").sortWithinPartitions("unit", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(bodies: list[int], held: list) -> pa.RecordBatch:
            a, b = links(held) if len(held) > 1 else ([], [])
            return pa.RecordBatch.from_arrays([pa.array([bodies[k] for k in x], pa.int64()) for x in (a, b)], names=["a", "b"])

        at, bodies, held = None, [], []
        for batch in batches:
            column = batch.column(4)
            if pa.types.is_list(column.type):
                values, ends = column.values.to_numpy().view(np.uint64), column.offsets.to_numpy()
                items = [values[lo:hi].copy() for lo, hi in zip(ends[:-1], ends[1:], strict=True)]
            else:
                items = column.to_pylist()
            for *place, body, item in zip(*(batch.column(k).to_pylist() for k in range(4)), items, strict=True):
                if place != at:
                    if len(held) > 1:
                        yield found(bodies, held)
                    at, bodies, held = place, [], []
                bodies.append(body)
                held.append(item)
        if len(held) > 1:
            yield found(bodies, held)

    return laid.mapInArrow(run, "a long, b long")


def groups(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, roots) of ``docs(id, key, text)``, key being the identity of id and text.

    rows: (id, key, body) for every row; roots: (body, root) for the bodies that have near copies.
    """
    base = materialize(prints(docs), "stage-prints")
    laid = base.select("body", F.explode("bands").alias("band"))
    shared = laid.groupBy("band").agg(F.min("body").alias("lo"), F.max("body").alias("hi")).where("lo <> hi").select("band")
    members = materialize(laid.join(materialize(shared, "bands"), "band").distinct(), "members")
    big = materialize(members.groupBy("band").count().where(F.col("count") > PART).select("band", (F.ceil(F.col("count") / PART) + 1).cast("long").alias("g")), "big")
    sigs = base.where("sig is not null").select("body", "sig").distinct()
    # One text stands for each fingerprint; the others of it and the trie's links lead to it.
    stands = materialize(base.where("fp is not null").groupBy("fp").agg(F.min("body").alias("b")), "fingerprints")
    close = simhash.near_links(stands.select("fp")).withColumnRenamed("b", "fp")
    close = close.join(stands, "fp").select(F.col("a").alias("fp"), F.col("b").alias("y")).join(stands, "fp").select(F.col("b").alias("a"), F.col("y").alias("b"))
    equal = base.select("fp", F.col("body").alias("a")).join(stands, "fp").where("a <> b").select("a", "b").distinct()
    rough = connected_components(_in_units(members.join(sigs, "body"), big, "band", "sig", alike).union(close).union(equal))
    rough = materialize(rough.select(F.col("node").alias("body"), F.col("root").alias("rough")), "rough")

    sizes = base.select("body", "n").distinct().join(rough, "body").groupBy("rough").agg(F.count("*").alias("texts"), F.sum("n").alias("n"))
    parts = F.ceil(F.greatest(F.col("texts") / PART, F.col("n") / PART_SHINGLES)).cast("long")
    parts = materialize(sizes.select("rough", (parts + 1).alias("g")).where("g > 2"), "parts")
    named = base.groupBy("body").agg(F.min("key").alias("key")).join(rough, "body")
    named = materialize(named.select(F.col("key").alias("__k"), "body", "rough"), "named")
    texts = docs.select("key", "text").join(named, F.col("key") == F.col("__k")).select("rough", "body", "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t).view(np.int64) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(sets, pa.list_(pa.int64()))], names=["rough", "body", "set"])

    # A row that is there twice gives a link of a body to itself, which is dropped.
    sets = materialize(texts.mapInArrow(cut, "rough long, body long, set array<long>"), "sets")
    roots = connected_components(_in_units(sets, parts, "rough", "set", similar))
    return base.select("id", "key", "body"), roots.select(F.col("node").alias("body"), "root")
