"""Language identification by prediction by partial matching.

Each language has a variable-order context tree over bytes (at most ORDER bytes of context). A
byte seen in a context costs -log2(c / (n + d)) bits, n being the context's count and d its
distinct bytes; another one costs the escape -log2(d / (n + d)) and is then coded in the next
shorter context, down to a uniform code of 8 bits. The statistics are frozen after training, so a
byte's whole cost depends on its last ORDER bytes alone. A tree is kept as sorted arrays of the
contexts and grams it has seen, some 12 bytes each, whatever the number of languages or scripts;
the distinct grams of a batch are looked up once for each language, and a text's exact code length
is a sum over its bytes. The language of the shortest code wins.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import materialize, small_batches

ORDER, BYTE, START = 3, 8, 32
#: At most about so many documents of each language are learned from (a hash of the id decides which).
MAX_TRAIN = 2000
HELD_OUT = 2
#: Bytes scored together; a matter of memory only.
CHUNK = 1 << 21
_LATIN = re.compile("[A-Za-z]")
Tree = list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


def grams(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, starts, ends): each byte with the ORDER before it, for all texts of a column.

    A text starts in the context of ORDER spaces; a null is an empty text.
    """
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    lengths = np.diff(offsets).astype(np.int64)
    starts = np.cumsum(lengths) - lengths + ORDER * np.arange(1, len(lengths) + 1)
    symbols = np.full(lengths.sum() + ORDER * len(lengths), START, np.uint32)
    for a, n, s in zip(offsets[:-1].tolist(), lengths.tolist(), starts.tolist(), strict=True):
        symbols[s : s + n] = data[a : a + n]
    codes = symbols.copy()
    for back in range(1, ORDER + 1):
        codes[back:] |= symbols[:-back] << np.uint32(BYTE * back)
    return codes, starts, starts + lengths


def tree(gram: np.ndarray, count: np.ndarray) -> Tree:
    """From the longest context to the empty one: (grams, their cost, contexts, their escape's cost)."""
    out = []
    for k in range(ORDER, -1, -1):
        keys, back = np.unique(gram & np.uint32((1 << BYTE * (k + 1)) - 1), return_inverse=True)
        seen = np.bincount(back, count)
        contexts, row = np.unique(keys >> np.uint32(BYTE), return_inverse=True)
        total, kinds = np.bincount(row, seen), np.bincount(row)
        out.append((keys, -np.log2(seen / (total + kinds)[row]), contexts, -np.log2(kinds / (total + kinds))))
    return out


def _found(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, whether it is there) of each wanted value in sorted keys."""
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def code_lengths(tree: Tree, gram: np.ndarray) -> np.ndarray:
    """Bits of the last byte of each gram."""
    out, left, codes = np.zeros(len(gram)), np.arange(len(gram)), gram
    for k, (keys, cost, contexts, escape) in zip(range(ORDER, -1, -1), tree, strict=True):
        codes = codes & np.uint32((1 << BYTE * (k + 1)) - 1)
        at, hit = _found(keys, codes)
        out[left[hit]] += cost[at[hit]]
        left, codes = left[~hit], codes[~hit]
        at, known = _found(contexts, codes >> np.uint32(BYTE))
        out[left[known]] += escape[at[known]]
    out[left] += BYTE
    return out


def text_bits(trees: list[Tree], column: pa.Array) -> np.ndarray:
    """Code length of each text (rows) under each tree (columns)."""
    codes, starts, ends = grams(column)
    bits = np.zeros((len(starts), len(trees)))
    for low in range(0, len(codes), CHUNK):
        part = codes[low : low + CHUNK]
        kinds, back = np.unique(part, return_inverse=True)
        first, last = (np.clip(x - low, 0, len(part)) for x in (starts, ends))
        for k, t in enumerate(trees):
            upto = np.concatenate(([0.0], np.cumsum(code_lengths(t, kinds)[back])))
            bits[:, k] += upto[last] - upto[first]
    return bits


def _held_out(id_col: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(4)) == HELD_OUT, F.lit(False))


def trained(docs: DataFrame, id_col: str, text_col: str, lang_col: str, max_train: int = MAX_TRAIN) -> dict[str, Tree]:
    """Languages, in alphabetical order, with their trees, learned from a bounded sample.

    Only languages with a text of some length among the rows to learn from are learned.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.where(F.col("id").isNotNull() & F.col("lang").isNotNull() & (F.length("text") > 0) & ~_held_out(F.col("id")))
    counts = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}
    names = sorted(counts)
    if not names:
        return {}
    share = F.create_map(*[F.lit(x) for n in names for x in (n, min(1.0, max_train / counts[n]))])
    drawn = F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(1 << 30)) < F.element_at(share, F.col("lang")) * (1 << 30)
    place = F.create_map(*[F.lit(x) for k, n in enumerate(names) for x in (n, k)])
    sample = materialize(rows.where(drawn).select("text", F.element_at(place, F.col("lang")).alias("k")), "sample")

    def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, starts, ends = grams(batch.column(0))
            own = np.full(len(codes), -1, np.int64)
            for s, e, k in zip(starts.tolist(), ends.tolist(), batch.column(1).to_pylist(), strict=True):
                own[s:e] = k
            inside = own >= 0
            both, n = np.unique(own[inside] << 32 | codes[inside].astype(np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(both), pa.array(n)], names=["g", "n"])

    found = sample.mapInArrow(count_grams, "g long, n long").groupBy("g").agg(F.sum("n").alias("n")).toArrow()
    g, n = found.column("g").to_numpy(), found.column("n").to_numpy()
    own, gram = g >> 32, (g & 0xFFFFFFFF).astype(np.uint32)
    return {name: tree(gram[own == k], n[own == k]) for k, name in enumerate(names) if (own == k).any()}


def identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_train: int = MAX_TRAIN) -> DataFrame:
    """(id, held_out, lang_pred, score) for every row of ``docs``.

    score is the language's share of the posterior, 2**-bits over the sum of all languages'.
    Nulls: a null text, like one without a letter, is ``und`` with score 0; rows without an id, a
    text or a language are not learned from; a null id is not held out. Repeated rows are
    predicted each. Ties go to the first language in alphabetical order. With nothing to learn
    from all is ``und``. Other columns are not read.
    """
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(trained(docs, id_col, text_col, lang_col, max_train))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(_held_out(F.col(id_col)), F.lit(False)).alias("held_out"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, trees = list(sent.value), list(sent.value.values())
        for batch in batches:
            letters = [bool(_LATIN.search(t)) or any(map(str.isalpha, t)) for t in batch.column(2).to_pylist()]
            known = np.array(letters, bool) & bool(names)
            bits = text_bits(trees, batch.column(2)) if names else np.zeros((len(known), 1))
            best = bits.argmin(axis=1)
            share = 1 / np.exp2(bits.min(axis=1, keepdims=True) - bits).sum(axis=1)
            pred = [names[b] if ok else "und" for b, ok in zip(best.tolist(), known.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(pred, pa.string()), pa.array(np.where(known, share, 0.0))], names=["id", "held_out", "lang_pred", "score"])

    return rows.mapInArrow(run, "id long, held_out boolean, lang_pred string, score double")
