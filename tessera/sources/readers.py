"""Importers: tables and files as frames with an ``_id`` column."""

from __future__ import annotations

import configparser
import sqlite3
import tomllib
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.plans.storage import cut

#: Rows of one SQLite batch; full batches are written to shared storage, so that the driver holds one.
BATCH = 50_000


def _keyed(df: DataFrame, key: str | None) -> DataFrame:
    key = key or df.columns[0]
    return df.select(F.col(f"`{key}`").cast("string").alias("_id"), *[F.col(f"`{c}`") for c in df.columns if c != key])


def from_csv(spark: SparkSession, path: str, key: str | None = None, **options: Any) -> DataFrame:
    """A CSV with a header; every value stays text; the key is the first column unless named.

    The header is read alone, so no pass over the data infers types.
    """
    reader = spark.read.options(header=True, inferSchema=False, escape='"', multiLine=options.pop("multiLine", False), **options)
    return _keyed(reader.csv(path), key)


def from_parquet(spark: SparkSession, path: str, key: str | None = None, columns: list[str] | None = None) -> DataFrame:
    """Parquet files; only the named columns and the key are read."""
    df = spark.read.parquet(path)
    key = key or df.columns[0]
    if columns is not None:
        df = df.select(*dict.fromkeys([key, *columns]))
    return _keyed(df, key)


def from_json_lines(spark: SparkSession, path: str, key: str | None = None, schema: T.StructType | str | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return _keyed(reader.json(path), key)


def from_sqlite(spark: SparkSession, path: str, batch: int = BATCH) -> dict[str, DataFrame]:
    """Each table of a SQLite file as a group.

    Primary-key columns, joined by ``|``, become the key and leave the value; rows of a table
    without one are numbered. A local file has one reader: it is read in batches by the driver.
    """
    out = {}
    with sqlite3.connect(path) as db:
        names = [r[0] for r in db.execute("SELECT name FROM sqlite_master WHERE type = 'table' AND name NOT LIKE 'sqlite_%' ORDER BY name")]
        for name in names:
            info = db.execute(f'PRAGMA table_info("{name}")').fetchall()
            keys = [c[1] for c in sorted(info, key=lambda c: c[5]) if c[5]]
            schema = T.StructType([T.StructField(c[1], _sqlite_type(c[2])) for c in info])
            rows = db.execute(f'SELECT * FROM "{name}"')
            parts, n = [], 0
            while chunk := rows.fetchmany(batch):
                made = [tuple(_fit(v, f.dataType) for v, f in zip(r, schema.fields, strict=True)) + (str(n + k),) for k, r in enumerate(chunk)]
                part = spark.createDataFrame(made, T.StructType([*schema.fields, T.StructField("__n", T.StringType())]))
                n += len(chunk)
                parts.append(cut(part) if len(chunk) == batch else part)
            df = parts[0] if parts else spark.createDataFrame([], T.StructType([*schema.fields, T.StructField("__n", T.StringType())]))
            for p in parts[1:]:
                df = df.union(p)
            key = F.concat_ws("|", *[F.col(k).cast("string") for k in keys]) if keys else F.col("__n")
            out[name] = df.select(F.lit(name).alias("_group"), key.alias("_id"), *[c for c in schema.names if c not in keys])
    return out


def _sqlite_type(declared: str) -> T.DataType:
    d = declared.upper()
    if "INT" in d:
        return T.LongType()
    if any(x in d for x in ("REAL", "FLOA", "DOUB", "NUM", "DEC")):
        return T.DoubleType()
    return T.BinaryType() if "BLOB" in d else T.StringType()


def _fit(v: Any, t: T.DataType) -> Any:
    if v is None:
        return None
    if isinstance(t, T.DoubleType):
        return float(v)
    return str(v) if isinstance(t, T.StringType) else v


def _settings(spark: SparkSession, rows: list[tuple[str, Any]]) -> DataFrame:
    import json

    return spark.createDataFrame([(k, json.dumps(v, ensure_ascii=False, separators=(",", ":"), default=str)) for k, v in rows], "_id string, _json string")


def from_ini(spark: SparkSession, path: str) -> DataFrame:
    """(``_id`` section/key, ``_json``) of an INI file; values are text."""
    parser = configparser.ConfigParser()
    parser.optionxform = str  # type: ignore[assignment,method-assign]
    with open(path, encoding="utf-8") as f:
        parser.read_file(f)
    return _settings(spark, [(f"{s}/{k}", v) for s in parser.sections() for k, v in parser[s].items()])


def from_toml(spark: SparkSession, path: str) -> DataFrame:
    """(``_id`` section/key, ``_json``) of a TOML file; top-level values are ``/key``."""
    with open(path, "rb") as f:
        data = tomllib.load(f)
    rows = []
    for s, v in data.items():
        rows += [(f"{s}/{k}", x) for k, x in v.items()] if isinstance(v, dict) else [(f"/{s}", v)]
    return _settings(spark, rows)
