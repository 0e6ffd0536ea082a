"""JSON documents as columns: merging a patch, and the append-only check, without Python."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

TEXTS, VALUES = "map<string,string>", "map<string,variant>"


def quoted_text(text: Column) -> Column:
    """JSON text of a string."""
    wrapped = F.to_json(F.struct(text.alias("v")))
    return F.substring(wrapped, F.lit(6), F.length(wrapped) - 6)


def fields(text: Column) -> Column:
    """array<struct<key, value>> of an object's fields in order, values as JSON text.

    A parsed map of strings has lost its quotes; the types come from a map of variants beside it.
    """

    def value(entry: Column) -> Column:
        kind = F.schema_of_variant(F.try_element_at(F.from_json(text, VALUES), entry["key"]))
        plain = F.when(kind == "STRING", quoted_text(entry["value"])).otherwise(entry["value"])
        return F.struct(entry["key"].alias("key"), F.coalesce(plain, F.lit("null")).alias("value"))

    return F.transform(F.map_entries(F.from_json(text, TEXTS)), value)


def merged(text: Column, patch: dict[str, Any]) -> Column:
    """A document with a patch merged in: new values in place, None removes, new fields at the end.

    Values other than objects stay.
    """
    put = {k: json.dumps(v, ensure_ascii=False, separators=(",", ":"), default=str) for k, v in patch.items() if v is not None}
    gone = [F.lit(k) for k, v in patch.items() if v is None]
    given = F.create_map(*[F.lit(x) for pair in put.items() for x in pair]) if put else F.create_map().cast(TEXTS)
    own = F.filter(fields(text), lambda e: ~F.array_contains(F.array(*gone), e["key"])) if gone else fields(text)
    own = F.transform(own, lambda e: F.struct(e["key"].alias("key"), F.coalesce(F.try_element_at(given, e["key"]), e["value"]).alias("value")))
    extra = F.filter(F.map_entries(given), lambda e: ~F.map_contains_key(F.from_json(text, TEXTS), e["key"]))
    parts = F.transform(F.concat(own, extra), lambda e: F.concat(quoted_text(e["key"]), F.lit(":"), e["value"]))
    return F.when(text.startswith("{"), F.concat(F.lit("{"), F.array_join(parts, ","), F.lit("}"))).otherwise(text)


def grown(old: Column, new: Column) -> Column:
    """Whether ``new`` is ``old`` with something added: the append-only check.

    Texts and lists grow at their end, so the old JSON text without its closing sign begins the
    new one; objects gain fields, so taking the new fields away leaves the old object.
    """
    a, b = (F.to_json(F.try_parse_json(x)) for x in (old, new))
    longer = F.length(b) > F.length(a)
    stem = F.substring(a, F.lit(1), F.length(a) - 1)
    text = a.startswith('"') & b.startswith(stem) & longer
    items = a.startswith("[") & F.when(a == "[]", b.startswith("[") & longer).otherwise(b.startswith(F.concat(stem, F.lit(","))))
    before, after = F.from_json(a, VALUES), F.from_json(b, VALUES)
    kept = F.map_filter(after, lambda k, v: F.map_contains_key(before, k))
    objects = a.startswith("{") & b.startswith("{") & (F.size(after) > F.size(before)) & (F.to_json(kept) == F.to_json(before))
    return F.coalesce(text | items | objects, F.lit(False))
