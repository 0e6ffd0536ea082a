"""WARC records in seekable Zstandard bundles.

A bundle is a run of independent Zstandard frames, each of which holds a group of whole records,
and ends with a seek table in a skippable frame (format of the public seekable extension: frame
magic 0x184D2A5E, one pair of compressed and decompressed size per frame, footer magic 0x8F92EAB1).
A side table maps each record's id to its bundle, frame and offset within the decompressed frame,
so one record is read by decompressing one frame.

Bundles are written by tasks under names that follow from their content's place in the input, by
rename, so a retried task replaces its own file.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm._common import materialize, shared_path, small_batches

FRAME_BYTES, BUNDLE_BYTES, REVISIT_MIN = 256 << 10, 32 << 20, 1000
# Fixed values of the seekable format.
SKIPPABLE_MAGIC, SEEKABLE_MAGIC = 0x184D2A5E, 0x8F92EAB1
_CRLF = b"\r\n"


def record(name: str, kind: str, uri: str, payload: bytes, digest: str, length: int, refers_to: str | None = None) -> bytes:
    """One WARC/1.1 record. A revisit has an empty block; the payload's length and digest are headers."""
    block = payload if kind == "response" else b""
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <{name}>",
        f"WARC-Target-URI: {uri}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {length}",
        *([f"WARC-Refers-To: <{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"] if refers_to else []),
        "Content-Type: text/html",
        f"Content-Length: {len(block)}",
    ]
    return _CRLF.join(x.encode("utf-8", "surrogatepass") for x in head) + _CRLF * 2 + block + _CRLF * 2


def parse_records(raw: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, headers, block) of the records of a decompressed frame."""
    at = 0
    while at < len(raw):
        end = raw.index(_CRLF * 2, at)
        lines = raw[at:end].decode("utf-8", "surrogatepass").split("\r\n")
        if lines[0] != "WARC/1.1":
            raise ValueError(f"no record at {at}")
        head = dict(x.split(": ", 1) for x in lines[1:])
        n = int(head["Content-Length"])
        yield at, head, raw[end + 4 : end + 4 + n]
        at = end + 8 + n


class BundleWriter:
    """Collects records into frames; ``finish`` gives the bundle's bytes."""

    def __init__(self, frame_bytes: int = FRAME_BYTES):
        self._limit, self._packer = frame_bytes, zstandard.ZstdCompressor(level=3)
        self._open, self._held, self._frames, self._sizes = [], 0, [], []
        self.bytes = 0

    def add(self, raw: bytes) -> tuple[int, int]:
        """(frame, offset) of the record within the bundle."""
        if self._held and self._held + len(raw) > self._limit:
            self._close()
        place = len(self._frames), self._held
        self._open.append(raw)
        self._held += len(raw)
        return place

    def _close(self) -> None:
        if self._held:
            packed = self._packer.compress(b"".join(self._open))
            self._frames.append(packed)
            self._sizes.append((len(packed), self._held))
            self.bytes += len(packed)
            self._open, self._held = [], 0

    def finish(self) -> bytes:
        self._close()
        entries = b"".join(struct.pack("<II", *x) for x in self._sizes)
        footer = struct.pack("<IBI", len(self._sizes), 0, SEEKABLE_MAGIC)
        return b"".join(self._frames) + struct.pack("<II", SKIPPABLE_MAGIC, len(entries) + len(footer)) + entries + footer


def seek_table(bundle: bytes) -> list[tuple[int, int, int]]:
    """(start, compressed size, decompressed size) of each frame, from the footer."""
    n, _, magic = struct.unpack("<IBI", bundle[-9:])
    if magic != SEEKABLE_MAGIC:
        raise ValueError("not a seekable bundle")
    out, at = [], 0
    for k in range(n):
        packed, plain = struct.unpack_from("<II", bundle, len(bundle) - 9 - 8 * (n - k))
        out.append((at, packed, plain))
        at += packed
    return out


def read_frame(bundle: bytes, frame: int) -> bytes:
    start, packed, plain = seek_table(bundle)[frame]
    return zstandard.ZstdDecompressor().decompress(bundle[start : start + packed], max_output_size=plain)


def _payload(col: str):
    return F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")


def revisits(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, digest, refers_to) of the rows that repeat another's payload of REVISIT_MIN bytes or more.

    The row with the largest id of each payload is the original; rows that share that id are
    originals too. Rows without an id are never revisits.
    """
    meta = pages.select(F.col(id_col).cast("long").alias("id"), F.sha1(_payload(html_col)).alias("digest"), F.octet_length(_payload(html_col)).alias("n"))
    meta = materialize(meta.where(F.col("n") >= REVISIT_MIN).select("id", "digest"), "digests")
    last = meta.groupBy("digest").agg(F.max("id").alias("refers_to"), F.min("id").alias("low")).where("low < refers_to").select("digest", "refers_to")
    return meta.join(materialize(last, "originals"), "digest").where("id < refers_to").distinct()


def write_bundles(pages: DataFrame, out: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Write every row of ``pages`` as a record under the URI ``out``; returns the index, written there too.

    Index: (id, bundle, frame, offset). Nulls: a null html is an empty payload, a null url an empty
    URI, a null id the record ``urn:page:null``. Repeated rows are written each. An empty table
    writes no bundle.
    """
    spark = pages.sparkSession
    small_batches(spark)
    again = materialize(revisits(pages, id_col, html_col), "revisits").select(F.col("id").alias("rid"), F.col("digest").alias("rdigest"), "refers_to")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"), _payload(html_col).alias("html"))
    rows = rows.withColumn("digest", F.sha1("html"))
    rows = rows.join(again, (F.col("id") == F.col("rid")) & (F.col("digest") == F.col("rdigest")), "left").select("id", "url", "html", "digest", "refers_to")
    rows = rows.sortWithinPartitions("id", "digest", "url")  # a retried task writes the same bundles

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pafs.FileSystem.from_uri(out)
        store.create_dir(root, recursive=True)
        task = TaskContext.get()
        bundle, writer, places = 0, BundleWriter(frame_bytes), []

        def flush() -> pa.RecordBatch:
            nonlocal bundle, writer, places
            name = f"part-{task.partitionId():06d}-{bundle:04d}.warc.zst"
            draft = f"{root}/.{name}.{task.taskAttemptId()}"
            with store.open_output_stream(draft, compression=None) as f:
                f.write(writer.finish())
            store.move(draft, f"{root}/{name}")
            columns = list(zip(*places, strict=True))
            batch = pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array([name] * len(places)), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int64())], names=["id", "bundle", "frame", "offset"])
            bundle, writer, places = bundle + 1, BundleWriter(frame_bytes), []
            return batch

        for batch in batches:
            for page, url, html, digest, to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                name = f"urn:page:{'null' if page is None else page}"
                url = url.replace("\r", "%0D").replace("\n", "%0A")
                raw = record(name, "response" if to is None else "revisit", url, html, digest, len(html), None if to is None else f"urn:page:{to}")
                places.append((page, *writer.add(raw)))
                if writer.bytes >= bundle_bytes:
                    yield flush()
        if places:
            yield flush()

    index = rows.mapInArrow(write, "id long, bundle string, frame int, offset long")
    index.write.mode("overwrite").parquet(f"{out}/index")
    return spark.read.parquet(f"{out}/index")


def read_bundles(spark: SparkSession, out: str) -> DataFrame:
    """Every record under ``out``: (id, bundle, frame, offset, record_type, url, payload_bytes, payload_digest, refers_to, block).

    Each response's digest and length are taken from its block and held against its headers; a
    revisit's are its headers'.
    """
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.read.schema(schema).format("binaryFile").option("pathGlobFilter", "part-*.warc.zst").load(out)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                bundle = content.as_py()
                for frame in range(len(seek_table(bundle))):
                    rows = []
                    for offset, head, block in parse_records(read_frame(bundle, frame)):
                        kind, digest, n = head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha1:"), int(head["X-Payload-Length"])
                        if kind == "response" and (hashlib.sha1(block).hexdigest(), len(block)) != (digest, n):
                            raise ValueError(f"{path}, frame {frame}, offset {offset}: payload does not fit its digest")
                        name, to = head["WARC-Record-ID"][10:-1], head.get("WARC-Refers-To", "")[10:-1]
                        rows.append((None if name == "null" else int(name), path.rsplit("/", 1)[1], frame, offset, kind, head["WARC-Target-URI"], n, digest, int(to) if to else None, block))
                    kinds = [pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["id", "bundle", "frame", "offset", "record_type", "url", "payload_bytes", "payload_digest", "refers_to", "block"])

    kinds = "id long, bundle string, frame int, offset long, record_type string, url string, payload_bytes long, payload_digest string, refers_to long, block binary"
    return files.select("path", "content").mapInArrow(parse, kinds)


def read_record(out: str, bundle: str, frame: int, offset: int) -> tuple[dict[str, str], bytes]:
    """One record by its place: the footer and one frame are read, nothing else."""
    store, root = pafs.FileSystem.from_uri(out)
    with store.open_input_file(f"{root}/{bundle}") as f:
        size = f.size()
        f.seek(size - 9)
        n = struct.unpack("<IBI", f.read(9))[0]
        f.seek(size - 9 - 8 * n)
        table = f.read(8 * n + 9)
        start, packed, plain = seek_table(table)[frame]
        f.seek(start)
        raw = zstandard.ZstdDecompressor().decompress(f.read(packed), max_output_size=plain)
    return next((head, block) for at, head, block in parse_records(raw) if at == offset)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` to the shared folder and read all records back."""
    spark = pages.sparkSession
    out = shared_path(spark, "warc")
    write_bundles(pages, out)
    return read_bundles(spark, out)


#: ``op7`` in DuckDB's SQL.
SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes FROM pages),
g AS (SELECT html, max(page_id) AS last FROM p GROUP BY 1)
SELECT page_id, payload_bytes, sha1(html) AS payload_digest,
  CASE WHEN payload_bytes >= {REVISIT_MIN} AND page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= {REVISIT_MIN} AND page_id < last THEN last END AS refers_to
FROM p JOIN g USING (html)
"""
