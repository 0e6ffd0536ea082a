"""Rules as column expressions over documents without a schema (a VARIANT column).

Covers what needs no recursion: paths of plain fields, comparisons, ranges, prefixes and suffixes,
and all junctions. ``None`` means that a rule needs the interpreter.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.plans.rules import Complement, Constant, Junction, Leaf, Node, Path, false_on_null

_NAME = re.compile(r"^[A-Za-z0-9_.$/|]+$")
_PLAIN = re.compile(r"^[A-Za-z_][A-Za-z0-9_]*$")


def _pick(doc: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(doc, path, kind)


def _kind(doc: Column, path: str) -> Column:
    return F.schema_of_variant(_pick(doc, path, "variant"))


def _leaf(doc: Column, path: str, node: Leaf) -> Column | None:
    op, arg = node.op, node.arg
    if op not in ("eq", "gt", "gte", "lt", "lte", "between", "near", "mod", "sw", "ew"):
        return None  # these mean something else to lists and mappings
    many = list(arg) if isinstance(arg, tuple | list) else [arg]
    text = all(isinstance(x, str) for x in many)
    if not many or not (text or all(isinstance(x, int | float) for x in many)):
        return None
    kind = _kind(doc, path)
    if text:
        c = F.when(kind == "STRING", _pick(doc, path, "string"))
    elif op in ("sw", "ew"):
        return None
    else:  # only numbers and booleans are read as numbers, never text
        c = F.when(kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL"), _pick(doc, path, "double"))
        c = F.when(kind == "BOOLEAN", _pick(doc, path, "boolean").cast("double")).otherwise(c)
        many = [float(x) for x in many]
        arg = many[0]
    if op in ("sw", "ew"):
        test = reduce(lambda x, y: x | y, [c.startswith(x) if op == "sw" else c.endswith(x) for x in many])
    elif op == "between":
        test = (c >= many[0]) & (c <= many[1])
    elif op == "near":
        test = F.abs(c - many[0]) <= many[1]
    elif op == "mod":
        test = c - F.lit(float(many[0])) * F.floor(c / many[0]) == many[1]
    else:
        test = {"eq": lambda: c == arg, "gt": lambda: c > arg, "gte": lambda: c >= arg, "lt": lambda: c < arg, "lte": lambda: c <= arg}[op]()
    return F.coalesce(~test if node.invert else test, F.lit(False))


def compiled(node: Node, doc: Column, path: str = "$") -> Column | None:
    """A never-null boolean column, or None."""
    if isinstance(node, Constant):
        return F.lit(node.value)
    if isinstance(node, Junction):
        parts = [compiled(n, doc, path) for n in node.items]
        if any(p is None for p in parts):
            return None
        return reduce(lambda x, y: x & y if node.every else x | y, parts) if parts else F.lit(node.every)
    if isinstance(node, Complement):
        inner = compiled(node.item, doc, path)
        return None if inner is None else ~inner
    if isinstance(node, Path):
        if node.meta or node.wild or node.invert:
            return None
        steps, rule, flip = node.readings[0] if node.readings else ((), node.exact, False)
        names = [s.name for s in steps] if node.readings else [node.text]
        if flip or len(node.readings) > 1 or any(s.kind != "get" for s in steps) or not all(map(_PLAIN.match, names)):
            return None
        at = path + "".join(f".{n}" for n in names)
        inner = compiled(rule, doc, at)
        if inner is None:
            return None
        if not false_on_null(rule):
            inner = _pick(doc, at, "variant").isNotNull() & inner
        if len(names) == 1:
            return inner
        # A field of the whole name comes before the path.
        if not _NAME.match(node.text):
            return None
        own = f"{path}['{node.text}']"
        exact = compiled(node.exact, doc, own)
        return None if exact is None else F.when(_pick(doc, own, "variant").isNotNull(), exact).otherwise(inner)
    if isinstance(node, Leaf):
        return _leaf(doc, path, node)
    return None
