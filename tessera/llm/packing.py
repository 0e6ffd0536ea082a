"""Lexical retrieval packing.

Documents are tokenized, and document frequencies of all tokens are counted over the whole table.
Each document has a lexical signature: SIGNS weighted min-hashes of its tokens (weights are BM25's
inverse document frequencies), each the token that comes first in a random order. The table is
range-partitioned and sorted by signature, so that texts with the same telling tokens lie together,
however many tasks there are; a signature that many documents share is cut by the next min-hash and
in the end by the row. Runs of SHARD documents (fewer where they have over SHARD_TOKENS tokens) are
the shards of the BM25 inverted index, with the whole table's statistics; the first unused document
seeds a window, its shard returns its unused neighbours by score, and they fill the window greedily.
The document that overflows is cut; its rest seeds the next window, and the last window of a shard
is carried into the next, so that a task pads one window at most.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import materialize, small_batches

WINDOW, END, SHARD, SHARD_TOKENS, SIGNS, K1, B = 2048, 1, 512, 1 << 21, 3, 1.2, 0.75
VOCABULARY = 1 << 16  # a token id has 16 bits
TOKENIZER = "/opt/tokenizers/word_bpe_49k.json"
#: Words whose ids are kept; beyond, all are forgotten (a matter of speed only).
_KEPT_WORDS = 1 << 20
#: A comma or stop between a letter or digit and white space is a word of its own.
_STOPS = re.compile(rb"(?:(?<=[a-z0-9])|(?<=\xc3[\x9f-\xb6\xb8-\xbf]))([,.])(?=[\x20\x09-\x0d])")
#: Classes of bytes: a letter or digit, h end of a Latin-1 letter, X start of any other character
#: beyond ASCII, s white space, c comma or stop, p the rest.
_CLASS = bytes(
    ord("a" if chr(b) in "abcdefghijklmnopqrstuvwxyz0123456789" else "s" if b in (9, 10, 11, 12, 13, 32) else "c" if b in (44, 46) else "p" if b < 128 else "h" if 0x9F <= b <= 0xBF and b != 0xB7 else "X" if b >= 0xC0 and b != 0xC3 else "p")
    for b in range(256)
)
#: Bytes of words, and bytes that no word of lower-case Latin-1 letters has.
_INSIDE = np.array([b not in (9, 10, 11, 12, 13, 32) for b in range(256)])
_ODD = np.array([not (97 <= b <= 122 or b == 0xC3 or (0x9F <= b <= 0xBF and b != 0xB7)) for b in range(256)])
_LOW = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB], np.uint64)
_LONG = 64
#: Texts tokenized together.
_TOGETHER = 256


def tokenizer_path() -> str:
    try:
        import public_tokenizers
    except ImportError:
        return TOKENIZER
    return str(public_tokenizers.path("word_bpe_49k.json"))


def _stops_apart(raw: bytes) -> bytes:
    """White space before each comma or stop that is a word of its own."""
    kinds = raw.translate(_CLASS)
    if b"X" in kinds or b"pcs" in kinds or b"ccs" in kinds:
        return _STOPS.sub(rb" \1", raw)
    return raw.replace(b", ", b" , ").replace(b". ", b" . ").replace(b".\n", b" .\n")


class WordTokenizer:
    """Ids of whole texts through a memory of words.

    The vocabulary's normalizer and splitter never join across ASCII white space, so a text's ids
    are those of its white-space separated parts in order. Words are found, hashed (128 bits) and
    looked up in arrays, many texts at once; only words not met before go to the model. Those of
    lower-case Latin letters alone need neither normalizer nor splitter there.
    """

    SLOTS = 1 << 21

    def __init__(self, path: str):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self._whole, self._letters = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self._letters.normalizer = normalizers.Sequence([])
        split = [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        self._letters.pre_tokenizer = pre_tokenizers.Sequence(split)
        last = [i for t, i in self._whole.get_vocab(with_added_tokens=False).items() if t.endswith("</w>")]
        self._last = np.zeros(1 << 16, bool)
        self._last[last] = True
        self._forget()

    def _forget(self) -> None:
        """Empty memory but for entry 0, the end token."""
        self._slots = np.full(self.SLOTS, -1, np.int32)
        self._hash = np.zeros((2, 1024), np.uint64)
        self._at, self._n = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self._pool = np.zeros(1 << 16, np.uint16)
        self._pool[0] = END
        self._n[0], self._used, self._filled = 1, 1, 1

    def _encode(self, words: list[bytes], plain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, number of ids of each), plain words first."""
        easy = [words[k] for k in np.flatnonzero(plain)]
        hard = [words[k].decode() for k in np.flatnonzero(~plain)]
        lines = [b" ".join(easy[k : k + 100]).decode() for k in range(0, len(easy), 100)]
        flat = [i for e in self._letters.encode_batch_fast(lines, add_special_tokens=False) for i in e.ids]
        ends = np.flatnonzero(self._last[np.array(flat, np.int64)]) + 1
        if len(ends) != len(easy):
            raise ValueError("the vocabulary has words without an end")
        more = [e.ids for e in self._whole.encode_batch_fast(hard, add_special_tokens=False)]
        sizes = np.concatenate((np.diff(ends, prepend=0), np.array([len(x) for x in more], np.int64)))
        return np.array(flat + [i for x in more for i in x], np.uint16), sizes

    def _learn(self, words: list[bytes], plain: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """Remember new words with their hashes; returns their entries."""
        ids, sizes = self._encode(words, plain)
        order = np.concatenate((np.flatnonzero(plain), np.flatnonzero(~plain)))
        first, n = self._used, len(words)
        while first + n > len(self._at):
            self._hash = np.concatenate((self._hash, np.zeros_like(self._hash)), axis=1)
            self._at, self._n = (np.concatenate((x, np.zeros_like(x))) for x in (self._at, self._n))
        while self._filled + len(ids) > len(self._pool):
            self._pool = np.concatenate((self._pool, np.zeros_like(self._pool)))
        self._pool[self._filled : self._filled + len(ids)] = ids
        self._hash[:, first : first + n] = hashes[:, order]
        self._n[first : first + n] = sizes
        self._at[first : first + n] = self._filled + np.cumsum(sizes) - sizes
        self._used, self._filled = first + n, self._filled + len(ids)
        entry = np.arange(first, first + n)
        left, slot = entry, self._hash[0, entry] >> np.uint64(43)
        while len(left):
            free = self._slots[slot] < 0
            place, pick = np.unique(slot[free], return_index=True)
            took = np.flatnonzero(free)[pick]
            self._slots[place] = left[took]
            rest = np.ones(len(left), bool)
            rest[took] = False
            left, slot = left[rest], (slot[rest] + np.uint64(1)) & np.uint64(self.SLOTS - 1)
        out = np.empty(n, np.int64)
        out[order] = entry
        return out

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """Entry of each word, -1 where it is new."""
        out = np.full(hashes.shape[1], -1, np.int64)
        at, slot = np.arange(len(out)), hashes[0] >> np.uint64(43)
        while len(at):
            e = self._slots[slot]
            same = (e > 0) & (self._hash[0, e] == hashes[0, at]) & (self._hash[1, e] == hashes[1, at])
            out[at[same]] = e[same]
            go = (e >= 0) & ~same
            at, slot = at[go], (slot[go] + np.uint64(1)) & np.uint64(self.SLOTS - 1)
        return out

    def __call__(self, texts: list[str | None]) -> list[np.ndarray]:
        if self._used > _KEPT_WORDS:
            self._forget()
        raws = []
        for text in texts:
            text = text or ""
            if "<|" not in text and "\u03a3" not in text:
                text = text.lower()  # as the normalizer does, but for special tokens and the final sigma
            raws.append(_stops_apart(text.encode("utf-8", "replace")))
        flat = b" ".join(raws) + b" " * 17
        a = np.frombuffer(flat, np.uint8)
        inside = _INSIDE[a]
        turns = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        turns = np.concatenate(([0], turns)) if inside[0] else turns
        starts, ends = turns[0::2], turns[1::2]
        hashes = _word_hashes(flat, a, starts, ends)
        entry = self._find(hashes)
        new = np.flatnonzero(entry < 0)
        if len(new):
            order = np.lexsort(hashes[:, new])
            pair = hashes[:, new[order]]
            fresh = np.concatenate(([True], (pair[:, 1:] != pair[:, :-1]).any(axis=0)))
            one, back = new[order[fresh]], np.empty(len(new), np.int64)
            back[order] = np.cumsum(fresh) - 1
            odd = np.cumsum(_ODD[a])
            plain = odd[ends[one] - 1] == np.where(starts[one] > 0, odd[starts[one] - 1], 0)
            words = [flat[x:y] for x, y in zip(starts[one].tolist(), ends[one].tolist(), strict=True)]
            entry[new] = self._learn(words, plain, hashes[:, one])[back]
        stops = np.cumsum([len(r) + 1 for r in raws])
        upto = np.searchsorted(starts, stops)
        entry = np.insert(entry, upto, 0)
        sizes = self._n[entry]
        done = np.cumsum(sizes)
        ids = self._pool[np.repeat(self._at[entry] - (done - sizes), sizes) + np.arange(done[-1] if len(done) else 0)]
        return np.split(ids, done[upto + np.arange(len(texts))][:-1]) if texts else []


def _word_hashes(flat: bytes, a: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Two 64-bit hashes of each word, eight bytes at a step; long words one by one."""
    eight = np.ndarray(len(a) - 8, "<u8", flat, strides=(1,))
    size = ends - starts
    out = np.empty((2, len(size)), np.uint64)
    out[0] = size.astype(np.uint64) * _MIX[0]
    out[1] = size.astype(np.uint64) * _MIX[1]
    at = np.flatnonzero(size <= _LONG)
    step = 0
    while len(at):
        part = eight[starts[at] + step] & _LOW[np.minimum(size[at] - step, 8)]
        for k in (0, 1):
            h = (out[k, at] ^ part) * _MIX[2 + k]
            out[k, at] = h ^ (h >> np.uint64(29 + 3 * k))
        step += 8
        at = at[size[at] > step]
    out[0] *= _MIX[1]
    for k in np.flatnonzero(size > _LONG).tolist():
        both = xxhash.xxh3_128_intdigest(flat[starts[k] : ends[k]])
        out[0, k], out[1, k] = both & (1 << 64) - 1, both >> 64
    return out


@lru_cache(maxsize=1)
def word_tokenizer(path: str) -> WordTokenizer:
    """One per worker, so that its memory serves all its tasks."""
    return WordTokenizer(path)


class Statistics:
    """What BM25 knows of all documents: inverse document frequency of each token, mean length."""

    def __init__(self, documents: int, tokens: int, df: np.ndarray):
        self.idf = np.log1p((documents - df + 0.5) / (df + 0.5)).astype(np.float32)
        self.mean = max(tokens / max(documents, 1), 1.0)


def statistics_of(docs: list[np.ndarray]) -> Statistics:
    df = np.zeros(VOCABULARY, np.int64)
    for d in docs:
        df[np.unique(d)] += 1
    return Statistics(len(docs), sum(map(len, docs)), df)


class Index:
    """BM25 inverted index of one shard; terms are token ids.

    Postings of terms in more than DENSE documents are kept as rows over all documents, the
    others as lists; both are exact.
    """

    DENSE = 32

    def __init__(self, docs: list[np.ndarray], known: Statistics):
        n = len(docs)
        sizes = np.array([len(d) for d in docs], np.float32)
        bits = max(1, n - 1).bit_length()
        kind = np.uint32 if bits <= 16 else np.uint64  # a token id has 16 bits
        owner = np.repeat(np.arange(n, dtype=kind), sizes.astype(np.int64))
        pair, count = np.unique(np.concatenate(docs).astype(kind) << kind(bits) | owner, return_counts=True)
        term, owner = (pair >> kind(bits)).astype(np.int64), (pair & kind((1 << bits) - 1)).astype(np.int64)
        self.terms, first, df = np.unique(term, return_index=True, return_counts=True)
        norm = K1 * (1 - B + B * sizes / known.mean)
        weight = np.repeat(known.idf[self.terms], df) * (count * (K1 + 1) / (count + norm[owner])).astype(np.float32)
        self.first, self.df, self.owner, self.weight, self.n = first, df, owner, weight, n
        self.row = np.full(len(self.terms), -1)
        dense = np.flatnonzero(df > self.DENSE)
        self.row[dense] = np.arange(len(dense))
        self.dense = np.zeros((len(dense), n), np.float32)
        at = np.repeat(self.row, df)
        self.dense[at[at >= 0], owner[at >= 0]] = weight[at >= 0]
        by_doc = np.argsort(owner, kind="stable")
        self.query_terms = np.split(np.repeat(np.arange(len(self.terms)), df)[by_doc], np.cumsum(np.bincount(owner, minlength=n))[:-1])

    def scores(self, doc: int) -> np.ndarray:
        """Score of every document of the shard for the terms of ``doc``."""
        terms = self.query_terms[doc]
        rows = self.row[terms]
        out = self.dense[rows[rows >= 0]].sum(axis=0)
        rare = terms[rows < 0]
        n = self.df[rare]
        at = np.repeat(self.first[rare], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return out + np.bincount(self.owner[at], self.weight[at], self.n).astype(np.float32)


class Packer:
    """Fills windows; ``pieces`` are (document, start, length, crc32, window, offset)."""

    def __init__(self, window: int):
        self.window, self.at, self.room = window, 0, window

    def place(self, doc: int, ids: np.ndarray, start: int, pieces: list) -> int:
        """Put what fits from ``start`` on into the open window; returns the next start."""
        n = min(self.room, len(ids) - start)
        part = ids[start : start + n].astype("<u4").tobytes()
        pieces.append((doc, start, n, zlib.crc32(part), self.at, self.window - self.room))
        self.room -= n
        if not self.room:
            self.at, self.room = self.at + 1, self.window
        return start + n


def pack_shard(docs: list[np.ndarray], packer: Packer, known: Statistics) -> list[tuple]:
    index, n = Index(docs, known), len(docs)
    free, pieces, at = np.ones(n, bool), [], 0
    rest: tuple[int, int] | None = None
    while rest or free.any():
        if rest:
            seed, start = rest
        else:
            at += int(np.argmax(free[at:]))
            seed, start = at, 0
            free[seed] = False
        rest = None
        while start < len(docs[seed]):
            window = packer.at
            start = packer.place(seed, docs[seed], start, pieces)
        if packer.room == packer.window and packer.at != window:
            continue
        score = np.where(free, index.scores(seed), -1)
        for k in np.argsort(-score, kind="stable")[: int(free.sum())].tolist():
            free[k], window = False, packer.at
            start = packer.place(k, docs[k], 0, pieces)
            if packer.at != window:
                rest = (k, start) if start < len(docs[k]) else None
                break
    return pieces


def orders(known: Statistics) -> np.ndarray:
    """SIGNS random orders of all tokens (rows), in which telling tokens tend to come first."""
    u = np.random.default_rng(SHARD).random((SIGNS, VOCABULARY))
    place = np.argsort(np.argsort(-np.log1p(-u) / np.maximum(known.idf, 1e-6), axis=1, kind="stable"), axis=1, kind="stable")
    return place.astype(np.int32)


def _counted(rows: DataFrame) -> Statistics:
    """Statistics over all of ``rows(ids)``; what comes to the driver is bounded by the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(VOCABULARY, np.int64), np.zeros(2, np.int64)
        for batch in batches:
            for body in batch.column(0):
                ids = np.frombuffer(body.as_buffer(), np.uint16)
                df[np.unique(ids)] += 1
                n += (1, len(ids))
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(([-2, -1], at))), pa.array(np.concatenate((n, df[at])))], names=["term", "n"])

    found = rows.select("ids").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    term, n = found.column("term").to_numpy(), found.column("n").to_numpy()
    df = np.zeros(VOCABULARY, np.int64)
    df[term[term >= 0]] = n[term >= 0]
    return Statistics(int(n[term == -2].sum()), int(n[term == -1].sum()), df)


def packed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, shard: int = SHARD, path: str | None = None) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids): the pieces of all rows.

    Nulls: a null text is packed as an empty one (its end token alone); a null id is carried.
    Repeated rows are packed each. A text longer than the window spans several. An empty table
    gives no rows. Other columns are not read.
    """
    path = path or tokenizer_path()
    small_batches(docs.sparkSession)
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_tokenizer(path)
        for whole, at in ((w, k) for w in batches for k in range(0, w.num_rows, _TOGETHER)):
            batch = whole.slice(at, _TOGETHER)
            ids = encode(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in ids], pa.binary())], names=["id", "ids"])

    tokenized = slim.mapInArrow(tokenize, "id long, ids binary").withColumn("row", F.monotonically_increasing_id())
    tokenized = materialize(tokenized, "tokens")
    known = _counted(tokenized)
    sent = docs.sparkSession.sparkContext.broadcast(known)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = orders(sent.value)
        for batch in batches:
            all_ids = [np.frombuffer(x.as_buffer(), np.uint16) for x in batch.column(1)]
            first = [pa.array([int(p[x].min()) for x in all_ids], pa.int32()) for p in place]
            yield pa.RecordBatch.from_arrays([*batch.columns, *first], names=["id", "ids", "row", *signs])

    signs = [f"s{k}" for k in range(SIGNS)]
    signed = tokenized.mapInArrow(sign, "id long, ids binary, row long, " + ", ".join(f"{s} int" for s in signs))
    dealt = signed.repartitionByRange(*signs, "row").sortWithinPartitions(*signs, "row").select("id", "ids")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, packer = TaskContext.get().partitionId() << 40, Packer(window)
        names, docs, held = [], [], 0

        def flush() -> pa.RecordBatch:
            pieces = pack_shard(docs, packer, sent.value)
            owner = [p[0] for p in pieces]
            columns = [[names[k] for k in owner], [p[1] for p in pieces], [p[2] for p in pieces], [p[3] for p in pieces], [len(docs[k]) for k in owner], [base + p[4] for p in pieces], [p[5] for p in pieces]]
            ids = pa.array([docs[k][s : s + n].tobytes() for k, s, n, *_ in pieces], pa.binary())
            return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns), ids], names=["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])

        for batch in batches:
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                names.append(name)
                docs.append(np.frombuffer(body, np.uint16))
                held += len(docs[-1])
                if len(docs) == shard or held >= SHARD_TOKENS:
                    yield flush()
                    names.clear()
                    docs.clear()
                    held = 0
        if docs:
            yield flush()

    return dealt.mapInArrow(pack, "id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary")
