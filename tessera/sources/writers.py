"""Exporters, snapshots and value codecs."""

from __future__ import annotations

import bz2
import gzip
import json
import lzma
import zlib
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.collection import Collection

#: Parquet codec of each named compression that Parquet has.
COMPRESSION = {"no": "uncompressed", "gz": "gzip", "zs": "zstd", "br": "brotli", "lz": "lz4_raw"}
_PACK: dict[str, tuple[Callable, Callable]] = {"no": (bytes, bytes), "gz": (gzip.compress, gzip.decompress), "bz": (bz2.compress, bz2.decompress), "xz": (lzma.compress, lzma.decompress), "z1": (zlib.compress, zlib.decompress)}


def flat_frame(found: Collection, with_hidden: bool = False) -> DataFrame:
    """``_id`` and one column per field; lists and mappings inside a record as JSON text.

    Records that are no mappings have pseudo columns: ``__1__`` for a scalar, ``__V1__`` and so on
    for the elements of a list.
    """
    if not with_hidden:
        found = found.find()
    if not found.schemaless:
        return found.df.select("_id", *[_flat(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in found.schema.fields])
    df = found.df.select("_id", "_json", F.schema_of_variant(F.parse_json("_json")).alias("kind"))
    mapping, several = F.col("kind").startswith("OBJECT"), F.col("kind").startswith("ARRAY")
    shape = df.agg(
        F.count_if(mapping).alias("mappings"), F.count_if(~mapping & ~several).alias("scalars"),
        F.max(F.when(several, F.size(F.from_json("_json", "array<string>")))).alias("longest"),
    ).first()
    cols = []
    if shape.mappings:
        typed = Collection(df.where(mapping).select("_id", "_json")).typed().schema
        doc = F.from_json(F.when(mapping, F.col("_json")), typed)
        cols += [_flat(doc.getField(f.name), f.dataType).alias(f.name) for f in typed.fields]
    if shape.scalars:
        cols.append(F.when(~mapping & ~several, F.parse_json("_json").cast("string")).alias("__1__"))
    items = F.from_json(F.when(several, F.col("_json")), "array<string>")
    cols += [F.get(items, F.lit(k)).alias(f"__V{k + 1}__") for k in range(shape.longest or 0)]
    return df.select("_id", *cols)


def _flat(c: Column, t: T.DataType) -> Column:
    return F.to_json(c) if isinstance(t, T.ArrayType | T.StructType | T.MapType) else c


def to_csv(found: Collection, path: str, key: str = "_id", with_hidden: bool = False, single: bool = False) -> None:
    """Write records as CSV with a header. ``single`` makes one file, for results known to be small."""
    df = flat_frame(found, with_hidden).withColumnRenamed("_id", key)
    (df.coalesce(1) if single else df).write.mode("overwrite").options(header=True, escape='"').csv(path)


def backup(df: DataFrame, path: str, compression: str = "zs", partition_by: list[str] | None = None) -> None:
    """Snapshot as Parquet; a compression that Parquet has not is refused, never replaced by another."""
    if compression not in COMPRESSION:
        raise ValueError(f"Parquet has no compression {compression!r}: {', '.join(COMPRESSION)}")
    writer = df.write.mode("overwrite").option("compression", COMPRESSION[compression])
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def dumps(value: Any, compression: str = "no") -> bytes:
    """Any JSON-like value as bytes."""
    return _PACK[compression][0](json.dumps(value, ensure_ascii=False, separators=(",", ":")).encode())


def loads(raw: bytes, compression: str = "no") -> Any:
    return json.loads(_PACK[compression][1](raw))


def encoded(c: Column | str, encode: Callable[[str], bytes]) -> Column:
    """A user's value codec as a column, in Arrow batches."""
    return F.udf(lambda v: None if v is None else encode(v), T.BinaryType(), useArrow=True)(c)


def decoded(c: Column | str, decode: Callable[[bytes], str]) -> Column:
    return F.udf(lambda v: None if v is None else decode(bytes(v)), T.StringType(), useArrow=True)(c)
