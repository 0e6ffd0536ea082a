"""Sort keys: paths over values, keys and dates; rows whose key does not resolve come last."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.transforms import applied
from tessera.plans.query import Query, path_of
from tessera.plans.rules import SEPARATORS

_SCALARS = (T.StringType, T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BinaryType)


def split_path(text: str) -> list[str]:
    for sep in SEPARATORS:
        if sep in text:
            return text.split(sep)
    return [text]


def resolve(spec: Any, row: Any, schema: T.StructType) -> tuple[Column, T.DataType] | None:
    """(column, type) of a path with transforms over a row's fields."""
    text = path_of(spec)
    if text in schema.names:
        return row.getField(text), schema[text].dataType
    at: tuple[Any, T.DataType] | None = (row, schema)
    for part in split_path(text):
        if at is None:
            return None
        c, t = at
        if part.startswith("$"):
            at = applied(part[1:].lower(), c, t)
        elif isinstance(t, T.StructType):
            at = (c.getField(part), t[part].dataType) if part in t.names else None
        elif isinstance(t, T.MapType):
            at = F.try_element_at(c, F.lit(part)), t.valueType
        elif isinstance(t, T.ArrayType) and part.lstrip("-").isdigit():
            k = int(part)
            at = (F.get(c, F.lit(k)) if k >= 0 else F.try_element_at(c, F.lit(k))), t.elementType
        else:
            at = None
    return at


def sort_keys(spec: Any, reverse: bool, row: Any, schema: T.StructType, meta: dict[str, Column]) -> list[Column]:
    """Order-by columns of a sort specification.

    An integer sorts by the value (positive ascending, negative descending), a text or query by a
    path, a list by several. ``reverse`` turns every key; unresolved rows stay last, by key;
    equal rows keep their row order.
    """
    several = spec if isinstance(spec, list | tuple) else [spec]
    keys, missing = [], []
    for one in several:
        if isinstance(one, int) and not isinstance(one, Query):
            found = (row.getField(schema.names[0]), schema[0].dataType) if one and schema.names else None
            reverse = reverse or one < 0
        else:
            text = path_of(one)
            root = split_path(text)[0] if text else ""
            if root == "_id":
                found = meta["_id"], T.StringType()
                for part in split_path(text)[1:]:
                    found = found and applied(part.lstrip("$").lower(), *found)
            elif root == "_date":
                keys += [meta["_cdate"], meta["_mdate"]]
                continue
            else:
                found = resolve(one, row, schema)
        if found is None or not isinstance(found[1], _SCALARS):
            missing.append(F.lit(True))
            continue
        keys.append(found[0])
        missing.append(found[0].isNull())
    gone = F.lit(False)
    for m in missing:
        gone = gone | m
    turn = (lambda c: c.desc()) if reverse else (lambda c: c.asc())
    present = [turn(F.when(~gone, k)) for k in keys]
    return [gone.asc(), *present, turn(F.when(gone, meta["_id"])), meta["_row"].asc()]
