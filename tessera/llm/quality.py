"""Quality rules: per-text counts and cross-document line frequency.

Normalised lines are hashed; per host (``source``) the distinct documents that hold a line are
counted; lines in more documents than the host's limit are boilerplate and are removed from all
documents but the one with the smallest id; documents that lose over half of their word
characters so are rejected as depleted.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import identity, materialize, quoted, small_batches

MIN_WORDS, MAX_REPEATED, MIN_DOCS, SHARE, DEPLETED = 50, 0.5, 10, 0.001, 0.5
_SPACES, _SYMBOLS, _DIGITS = " \t\n\x0b\x0c\r", "#*$%&|<>", bytes.maketrans(b"0123456789", b"0" * 10)
_WORDLESS = re.compile(r"[\x20\x09-\x0D]*\Z")


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window found twice or more."""
    if len(words) < 4:
        return 0
    known: dict[bytes, int] = {}
    a = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
    if len(known) == len(a):
        return 0
    pairs = a[:-1] * len(known) + a[1:]
    if len(known) > 1_000_000:
        pairs = np.unique(pairs, return_inverse=True)[1]
    windows = pairs[:-1] * len(known) + a[2:]
    _, back, n = np.unique(windows, return_inverse=True, return_counts=True)
    again = n[back] > 1
    cover = np.zeros(len(a), bool)
    for k in range(3):
        cover[k : len(a) - 2 + k] |= again
    return int(cover.sum())


def measure(text: str | None) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lines, hashes, chars) of a text.

    lines, hashes and chars: index, 64-bit hash in normal form (ASCII lower case, one space
    between words, every digit 0) and word characters of each line that holds a word.
    """
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    lines = text.split("\n")
    full = [x for x in lines if not _WORDLESS.match(x)]
    at, hashes, chars = [], [], []
    for k, line in enumerate(lines):
        raw = line.encode("utf-8", "surrogatepass").split()
        if raw:
            at.append(k)
            hashes.append(xxhash.xxh64_intdigest(b" ".join(raw).lower().translate(_DIGITS)) - (1 << 63))
            chars.append(len(line) - sum(map(line.count, _SPACES)))
    return (
        len(words),
        len(text) - sum(map(text.count, _SPACES)),
        sum(map(text.count, _SYMBOLS)),
        len(full) - len(set(full)),
        repeated_words(words),
        at,
        hashes,
        chars,
    )


_COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """One row per row of ``docs``: key, id, host, body (the text's hash), the counts, and its lines."""
    small_batches(docs.sparkSession)
    slim = docs.select(
        F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.col(host_col).cast("string").alias("host")
    )
    slim = slim.select(identity("id", "text", "host").alias("key"), "id", F.coalesce("host", F.lit("")).alias("host"), F.xxhash64("text").alias("body"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(zip(*map(measure, batch.column(4).to_pylist()), strict=True)) or [()] * 8
            kinds = [pa.int64()] * 5 + [pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:4], *(pa.array(x, t) for x, t in zip(found, kinds, strict=True))],
                names=["key", "id", "host", "body", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "at", "line", "chars"],
            )

    return slim.mapInArrow(run, f"key string, id long, host string, body long, {_COLUMNS}, at array<int>, line array<long>, chars array<int>")


def verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """Counts and verdict of every row of ``docs``, with ``gone``: the indices of its removed lines.

    A host's limit is MIN_DOCS documents, or SHARE of its distinct texts where that is more;
    equal texts count as one document. Nulls: a null text has no words and fails; a null host is
    the host ''; a row with a null id never is the one that keeps a frequent line. Repeated rows
    each get the same verdict. An empty table gives no rows. Other columns are not read.
    """
    base = materialize(measured(docs, id_col, text_col, host_col).withColumn("row", F.monotonically_increasing_id()), "measured")
    lines = base.select("row", "id", "host", "body", F.explode(F.arrays_zip("at", "line", "chars")).alias("x"))
    lines = lines.select("row", "id", "host", "body", F.col("x.at").alias("at"), F.col("x.line").alias("line"), F.col("x.chars").alias("chars"))
    once = lines.groupBy("host", "line", "body").agg(F.min("id").alias("low"))
    often = once.groupBy("host", "line").agg(F.count("*").alias("n"), F.min("low").alias("keeper")).where(F.col("n") > MIN_DOCS)
    hosts = base.select("host", "body").distinct().groupBy("host").agg(F.count("*").alias("texts"))
    often = materialize(often.join(hosts, "host").where(F.col("n") > F.col("texts") * SHARE).select("host", "line", "keeper"), "often")
    cut = lines.join(often, ["host", "line"]).where(~F.col("id").eqNullSafe(F.col("keeper")))
    cut = materialize(cut.groupBy("row").agg(F.sort_array(F.collect_list("at")).alias("gone"), F.sum("chars").alias("lost")), "cut")
    out = base.drop("at", "line", "chars").join(cut, "row", "left")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 100 * MAX_REPEATED * F.col("n_words"))
    depleted = F.coalesce(F.col("lost") > DEPLETED * F.col("word_chars"), F.lit(False))
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & ~depleted)


def cleaned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """``docs`` without rejected rows and without frequent lines; columns as they were.

    Only rows with something to change are looked up; that table is broadcast when it is small
    enough by its true size, else the rows are joined by their identity.
    """
    acts = verdicts(docs, id_col, text_col, host_col).where(~F.col("kept") | F.col("gone").isNotNull())
    acts = acts.groupBy("key").agg(F.first("gone").alias("__gone"), F.first("kept").alias("__kept"))
    acts = materialize(acts.select(F.col("key").alias("__k"), "__gone", "__kept"), "acts")
    marked = docs.withColumn("__d", F.struct(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.col(host_col).cast("string").alias("host")))
    out = marked.join(acts, identity("__d.id", "__d.text", "__d.host") == F.col("__k"), "left")
    out = out.where(F.coalesce("__kept", F.lit(True)))
    text = F.when(F.col("__gone").isNull(), F.col(text_col)).otherwise(
        F.array_join(F.filter(F.split(F.col(text_col), "\n", -1), lambda x, i: ~F.array_contains("__gone", i)), "\n")
    )
    return out.select(*[text.alias(c) if c == text_col else quoted(c) for c in docs.columns])


#: ``op10`` in DuckDB's SQL.
SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, text IS NULL AS no_text, coalesce(source, '') AS host FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws, string_split(text, chr(10)) AS ls FROM d),
g AS (SELECT *, list_transform(range(1, greatest(len(ws) - 1, 1)), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) AS tri FROM w),
rep AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (
  SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM (
    SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, t) AS n
    FROM (SELECT doc_id, unnest(tri) AS t, unnest(range(1, len(tri) + 1)) AS i FROM g)) WHERE n > 1) GROUP BY 1),
l AS (SELECT doc_id, host, text, unnest(ls) AS raw FROM w),
m AS (SELECT doc_id, host, text, raw, regexp_extract_all(raw, '[^\x20\x09-\x0D]+') AS lw FROM l),
dup AS (SELECT doc_id, count(*) - count(DISTINCT raw) AS n_dup_lines FROM m WHERE len(lw) > 0 GROUP BY 1),
n AS (SELECT doc_id, host, text, len(regexp_replace(raw, '[\x20\x09-\x0D]', '', 'g')) AS chars,
  regexp_replace(translate(array_to_string(lw, ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9]', '0', 'g') AS line
  FROM m WHERE len(lw) > 0),
hosts AS (SELECT host, count(DISTINCT CASE WHEN no_text THEN 'n' ELSE 't' || text END) AS texts FROM d GROUP BY 1),
often AS (SELECT host, line, count(DISTINCT text) AS c, min(doc_id) AS keeper FROM n GROUP BY 1, 2),
cut AS (SELECT n.doc_id, sum(n.chars) AS lost FROM n JOIN often USING (host, line) JOIN hosts USING (host)
  WHERE c > {MIN_DOCS} AND c > texts * {SHARE} AND n.doc_id <> keeper GROUP BY 1),
r AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, len(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
  len(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
  coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(lost, 0) AS lost
  FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN dup USING (doc_id) LEFT JOIN cut USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words) AND NOT lost > {DEPLETED} * word_chars AS kept
FROM r
"""
