"""Group-by: ``category``, ``category.$avg``, ``[a, b, $sum]`` or ``{category: [price.$max, _id]}``."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.transforms import aggregated
from tessera.operators.sorting import resolve, split_path
from tessera.plans.query import path_of
from tessera.plans.rules import TRANSFORMS, RuleError


@dataclass
class GroupSpec:
    """keys: paths; op: aggregate for fields not listed; fields: (path, op) or None for all."""

    keys: list[str]
    op: str
    fields: list[tuple[str, str]] | None


def _op(part: str) -> str | None:
    name = part[1:].lower()
    return name if part.startswith("$") and (name in TRANSFORMS or name == "list") else None


def _trailing(path: str) -> tuple[str, str | None]:
    parts = split_path(path)
    op = _op(parts[-1])
    return (".".join(parts[:-1]), op) if op else (path, None)


def parse_group(spec: Any) -> GroupSpec:
    """Read a specification; one without a key is a RuleError."""
    if isinstance(spec, dict):
        if len(spec) != 1:
            raise RuleError("group_by takes one key specification")
        (key, fields), *_ = spec.items()
        keys = [path_of(k) for k in (key if isinstance(key, tuple | list) else [key])]
        listed = []
        for f in fields if isinstance(fields, list | tuple) else [fields]:
            path, op = _trailing(path_of(f))
            listed.append((path, op or "list"))
        return GroupSpec(keys, "list", listed)
    several = isinstance(spec, list | tuple)
    keys, op = [], None
    for part in spec if several else [spec]:
        text = path_of(part)
        if _op(text):
            op = _op(text)
            continue
        path, last = (text, None) if several else _trailing(text)
        op = last or op
        if not path:
            continue
        keys.append(path)
    if not keys:
        raise RuleError("group_by needs a key")
    return GroupSpec(keys, op or "list", None)


def grouped(df: DataFrame, spec: GroupSpec, row: Any, schema: T.StructType, meta: dict[str, Column]) -> DataFrame:
    """One row per group, in order of first appearance (column ``_row``); the key is ``_id`` (several: ``_id0``, ``_id1``); collected record keys are ``_ids``.

    A key that does not resolve is the null group. Every aggregate that can be is computed
    partially before the shuffle; lists gather one group's values, as their result does.
    """
    keys, names = [], []
    for k, path in enumerate(spec.keys):
        if path == "_id":
            found: Any = (meta["_id"], T.StringType())
        elif split_path(path)[0] == "_date":
            last = split_path(path)[-1]
            found = (meta["_cdate"] if last == "$first" else meta["_mdate"] if last == "$last" else F.concat_ws(" ", meta["_cdate"].cast("string"), meta["_mdate"].cast("string")), T.StringType())
        else:
            found = resolve(path, row, schema)
        keys.append((found[0] if found else F.lit(None).cast("string")).alias("_id" if len(spec.keys) == 1 else f"_id{k}"))
        names.append(path)
    listed = spec.fields
    if listed is None:
        listed = [(f.name, spec.op) for f in schema.fields if f.name not in names]
    outs, taken = [], set()
    for path, op in listed:
        name = path or "_val"
        if path == "_id":
            c, t = meta["_id"], T.StringType()
        else:
            found = resolve(path, row, schema) if path else (row.getField(schema.names[0]), schema[0].dataType)
            c, t = found if found else (F.lit(None).cast("string"), T.StringType())
        name = "_ids" if name == "_id" else f"{name}.${op}" if name in taken else name
        taken.add(name)
        outs.append(aggregated(op, c, t, meta["_row"]).alias(name))
    dates = [F.min(meta["_cdate"]).alias("_cdate"), F.max(meta["_mdate"]).alias("_mdate")] if meta.get("_dated") is not None else []
    return df.groupBy(*keys).agg(*outs, F.min(meta["_row"]).alias("_row"), *dates)
