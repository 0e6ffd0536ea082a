"""Rules as column expressions over typed columns.

Every leaf is two-valued: a null (missing) value, or one of another type than the rule's, is False
whether the leaf is inverted or not. Types are compared when the plan is built, so nothing is ever
coerced between text and numbers, and leaves that cannot hold fold to a constant.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.transforms import applied, as_number, is_number
from tessera.plans.interpret import JSON_SYMBOLS
from tessera.plans.row import RowColumns
from tessera.plans.rules import Apply, Complement, Constant, Index, Junction, Leaf, Node, Path, Quantified, Step, false_on_null, glob_pattern, java_pattern

_TEMPORAL = (T.DateType, T.TimestampType, T.TimestampNTZType)


class Scope:
    """Columns beside the value that a rule may name: the key and the two dates.

    ``loose``: the result is only filtered by, so a null may stand for False; leaves are then plain
    comparisons, which the scan can use. Anything that is negated is compiled strictly.
    """

    def __init__(self, key: Column | None = None, created: Column | None = None, modified: Column | None = None, loose: bool = False):
        self.key, self.created, self.modified, self.loose = key, created, modified, loose

    def strict(self) -> Scope:
        return Scope(self.key, self.created, self.modified)


def constant(value: bool) -> Column:
    return F.lit(value)


def _held(test: Column, invert: bool) -> Column:
    return F.coalesce(~test if invert else test, F.lit(False))


def _fits(t: T.DataType, arg: Any) -> bool:
    if isinstance(arg, bool | int | float):
        return is_number(t) or isinstance(t, T.BooleanType)
    if isinstance(arg, str):
        return isinstance(t, T.StringType)
    if isinstance(arg, bytes | bytearray):
        return isinstance(t, T.BinaryType)
    if isinstance(arg, dt.date):
        return isinstance(t, _TEMPORAL)
    if isinstance(arg, list | tuple):
        return isinstance(t, T.ArrayType) and all(_fits(t.elementType, x) for x in arg)
    return False


def literal(arg: Any, t: T.DataType) -> Column:
    if isinstance(arg, list | tuple):
        return F.array(*[literal(x, t.elementType) for x in arg]).cast(t)
    if isinstance(arg, bool) and not isinstance(t, T.BooleanType):
        return F.lit(int(arg))
    if isinstance(arg, bytearray):
        return F.lit(bytes(arg))
    return F.lit(arg)


def json_of(c: Column, t: T.DataType) -> Column:
    """Compact JSON text of a typed value (fields that are null are absent)."""
    c = _whole(c)
    return F.to_json(c) if isinstance(t, T.StructType | T.ArrayType | T.MapType) else c.cast("string")


def _operands(c: Column, t: T.DataType, arg: Any) -> tuple[Column, Column]:
    if isinstance(t, T.BooleanType) and isinstance(arg, bool):
        return c, F.lit(arg)
    return as_number(c, t)[0], literal(arg, t)


def _members(t: T.DataType, args: Any) -> list:
    return [a for a in args if _fits(t, a)]


def _leaf(op: str, arg: Any, invert: bool, c: Column, t: T.DataType, scope: Scope) -> Column:
    no = F.lit(False)
    held = (lambda test, flip: ~test if flip else test) if scope.loose else _held
    if op in ("eq", "gt", "gte", "lt", "lte"):
        if not _fits(t, arg):
            return no
        a, b = _operands(c, t, arg)
        return held({"eq": lambda: a == b, "gt": lambda: a > b, "gte": lambda: a >= b, "lt": lambda: a < b, "lte": lambda: a <= b}[op](), invert)
    if op == "between":
        low, high = arg
        if not (_fits(t, low) and _fits(t, high)):
            return no
        a = as_number(c, t)[0]
        return held((a >= literal(low, t)) & (a <= literal(high, t)), invert)
    if op in ("near", "mod"):
        if not (is_number(t) or isinstance(t, T.BooleanType)):
            return no
        a = as_number(c, t)[0]
        if op == "near":
            return held(F.abs(a - arg[0]) <= arg[1], invert)
        return held(a - F.lit(arg[0]) * F.floor(a / arg[0]) == arg[1], invert)
    if op in ("in", "anyin"):
        if isinstance(t, T.ArrayType):
            if isinstance(arg, str) or not hasattr(arg, "__iter__"):
                return no
            inside = _members(t.elementType, arg)
            own = F.array(*[literal(x, t.elementType) for x in inside]).cast(t) if inside else F.array().cast(t)
            if op == "anyin":
                return held(F.coalesce(F.arrays_overlap(c, own), F.when(c.isNotNull(), F.lit(False))), invert)
            return held(F.when(c.isNotNull(), (F.size(F.array_except(own, c)) == 0) & F.lit(len(inside) == len(list(arg)))), invert)
        if isinstance(t, T.StructType | T.MapType) or not hasattr(arg, "__contains__"):
            return no
        if isinstance(arg, str):
            return held(F.contains(F.lit(arg), c), invert) if isinstance(t, T.StringType) else no
        inside = _members(t, arg)
        a = as_number(c, t)[0] if not all(isinstance(x, bool) for x in inside) else c
        test = a.isin(*[int(x) if isinstance(x, bool) and a is not c else x for x in inside]) if inside else F.when(c.isNotNull(), F.lit(False))
        return held(test, invert)
    if op in ("has", "ihas"):
        fold = F.lower if op == "ihas" else lambda x: x
        low = (lambda x: x.lower() if isinstance(x, str) else x) if op == "ihas" else lambda x: x
        if isinstance(t, T.StringType):
            return held(F.contains(fold(c), F.lit(low(arg))), invert) if isinstance(arg, str) else no
        wanted = list(arg) if isinstance(arg, list | tuple | set | frozenset) else [arg]
        if isinstance(t, T.ArrayType):
            fit = all(_fits(t.elementType, x) for x in wanted)
            own = F.transform(c, fold) if op == "ihas" and isinstance(t.elementType, T.StringType) else c
            test = reduce(lambda x, y: x & y, [F.coalesce(F.array_contains(own, literal(low(x), t.elementType)), F.when(c.isNotNull(), F.lit(False))) for x in wanted], F.when(c.isNotNull(), F.lit(True))) if fit else F.when(c.isNotNull(), F.lit(False))
            return held(test, invert)
        if isinstance(t, T.StructType):
            names = {low(n): n for n in t.names}
            present = [c.getField(names[low(x)]).isNotNull() if low(x) in names else F.lit(False) for x in wanted]
            return held(F.when(c.isNotNull(), reduce(lambda x, y: x & y, present, F.lit(True))), invert)
        if isinstance(t, T.MapType):
            return held(F.when(c.isNotNull(), reduce(lambda x, y: x & y, [F.map_contains_key(c, x) for x in wanted], F.lit(True))), invert)
        return no
    if op in ("sw", "ew"):
        if isinstance(t, T.BinaryType):
            c, t = c.cast("string"), T.StringType()
        if not isinstance(t, T.StringType):
            return no
        ends = list(arg) if isinstance(arg, tuple | list | set) else [arg]
        return held(reduce(lambda x, y: x | y, [c.startswith(x) if op == "sw" else c.endswith(x) for x in ends]), invert)
    if op in ("re", "re2", "match"):
        several = list(arg) if isinstance(arg, list | tuple | set | frozenset) else [arg]
        rules = [java_pattern(p) for p in several if isinstance(p, str | re.Pattern)]
        if not rules:
            return no
        text = c if isinstance(t, T.StringType) else json_of(c, t)
        text = F.regexp_replace(text, JSON_SYMBOLS.pattern, "") if op == "re2" else text
        return held(reduce(lambda x, y: x & y, [text.rlike(rf"\A(?:{p})\z" if op == "match" else p) for p in rules]), invert)
    if op == "func":
        return held(_called(arg, c, scope), invert)
    if op == "size":
        size = F.length(c) if isinstance(t, T.StringType | T.BinaryType) else F.size(c) if isinstance(t, T.ArrayType | T.MapType) else F.lit(len(t)) if isinstance(t, T.StructType) else None
        if size is None:
            return no
        size = F.when(c.isNotNull(), size)
        return held(size == int(arg) if isinstance(arg, int | float) else size.isin(*arg), invert)
    if op == "type":
        found = _is_kind(t, arg)
        return no if found is None else _held(F.when(c.isNotNull(), F.lit(found)), invert)
    if op == "exists":
        wanted = [arg] if isinstance(arg, str) else list(arg)
        if isinstance(t, T.StructType):
            present = [c.getField(x).isNotNull() if x in t.names else F.lit(False) for x in wanted]
        elif isinstance(t, T.MapType):
            present = [F.map_contains_key(c, x) for x in wanted]
        else:
            return no
        return held(F.when(c.isNotNull(), reduce(lambda x, y: x & y, present, F.lit(True))), invert)
    raise ValueError(f"unknown operator {op}")


def _is_kind(t: T.DataType, kind: Any) -> bool | None:
    whole, real = is_number(t) and not isinstance(t, T.FloatType | T.DoubleType | T.DecimalType), isinstance(t, T.FloatType | T.DoubleType | T.DecimalType)
    flag = isinstance(t, T.BooleanType)
    named = {"int": whole, "bool": flag, "float": real, "str": isinstance(t, T.StringType), "bytes": isinstance(t, T.BinaryType), "list": isinstance(t, T.ArrayType), "dict": isinstance(t, T.StructType | T.MapType), "set": False, "tuple": False, "none": False}
    if isinstance(kind, type):
        return whole or flag if kind is int else named.get(kind.__name__, False)
    return named.get(kind.lower())


def _whole(c: Any) -> Column:
    return c.whole() if isinstance(c, RowColumns) else c


def _called(f: Callable, c: Column, scope: Scope) -> Column:
    """A Python callable over Arrow batches; an exception is False."""
    two = hasattr(f, "__code__") and f.__code__.co_argcount >= 2

    def plain(x: Any) -> Any:
        return x.asDict(recursive=True) if hasattr(x, "asDict") else x

    def run(k: Any, v: Any) -> bool:
        if v is None:
            return False
        try:
            return bool(f(k, plain(v)) if two else f(plain(v)))
        except Exception:  # noqa: BLE001 - a callable that fails does not match
            return False

    return F.udf(run, T.BooleanType(), useArrow=True)(scope.key if two and scope.key is not None else F.lit(""), _whole(c))


def _deep(node: Node, c: Column, t: T.DataType, every: bool, scope: Scope) -> Column:
    own = compiled(node, c, t, scope)
    return _below(node, c, t, every, scope, lambda x, xt: _deep(node, x, xt, every, scope)) | own if isinstance(t, T.ArrayType | T.StructType | T.MapType) else own


def _below(node: Node, c: Column, t: T.DataType, every: bool, scope: Scope, test: Callable[[Column, T.DataType], Column]) -> Column:
    if isinstance(t, T.StructType):
        parts = [F.when(c.getField(f.name).isNotNull(), test(c.getField(f.name), f.dataType)).otherwise(F.lit(every)) for f in t.fields]
        return reduce(lambda x, y: x & y if every else x | y, parts, F.lit(every))
    items, e = (c, t.elementType) if isinstance(t, T.ArrayType) else (F.map_values(c), t.valueType)
    return F.coalesce((F.forall if every else F.exists)(items, lambda x: test(x, e)), F.lit(False))


def _field(c: Column, t: T.DataType, name: str) -> tuple[Column, T.DataType] | None:
    if isinstance(t, T.StructType):
        return (c.getField(name), t[name].dataType) if name in t.names else None
    if isinstance(t, T.MapType):
        return F.try_element_at(c, F.lit(name)), t.valueType
    if isinstance(t, T.ArrayType) and re.fullmatch(r"-?\d+", name):
        k = int(name)
        return (F.get(c, F.lit(k)) if k >= 0 else F.try_element_at(c, F.lit(k))), t.elementType
    return None


def _reach(steps: tuple[Step, ...], c: Column, t: T.DataType, test: Callable[[Column, T.DataType], Column]) -> Column:
    """Whether any value that a path with wildcards reaches passes; wildcards expand on the schema."""
    if not steps:
        return test(c, t)
    step, rest = steps[0], steps[1:]
    go = lambda x, xt: _reach(rest, x, xt, test)
    no = F.lit(False)
    if step.kind == "transform":
        out = applied(step.name, c, t)
        return go(*out) if out else no
    if step.kind == "get":
        out = _field(c, t, step.name)
        return go(*out) if out else no
    found = go(c, t) if step.kind == "deep" else no
    onward = (lambda x, xt: _reach(steps, x, xt, test)) if step.kind == "deep" else go
    rx = None if step.kind in ("deep", "each") else re.compile(glob_pattern(step.name))
    if isinstance(t, T.StructType):
        for f in t.fields:
            if rx is None or rx.match(f.name):
                found = found | onward(c.getField(f.name), f.dataType)
        return found
    if isinstance(t, T.MapType):
        inner = F.map_filter(c, lambda k, _: k.rlike(rx.pattern)) if rx else c
        return found | F.coalesce(F.exists(F.map_values(inner), lambda x: onward(x, t.valueType)), no)
    if isinstance(t, T.ArrayType):
        if rx is None or step.name in ("?*", "*?"):
            return found | F.coalesce(F.exists(c, lambda x: onward(x, t.elementType)), no)
        if set(step.name) == {"?"}:
            first = 10 * (len(step.name) - 1)
            return F.coalesce(F.exists(F.slice(c, first + 1, 10), lambda x: onward(x, t.elementType)), no)
    return found


def _resolved(node: Node, c: Any, t: T.DataType, scope: Scope, invert: bool = False) -> Column:
    """A rule on a value that must be there, inverted or not."""
    if invert:
        return c.isNotNull() & ~compiled(node, c, t, scope.strict())
    test = compiled(node, c, t, scope)
    return test if false_on_null(node) else c.isNotNull() & test


def _path(node: Path, c: Column, t: T.DataType, scope: Scope) -> Column:
    out = _field(c, t, node.text) if not isinstance(t, T.ArrayType) else None
    if out and isinstance(t, T.StructType):
        return _resolved(node.exact, *out, scope, node.invert)
    if node.meta:
        name, rule = node.meta
        inner = scope.strict() if node.invert else scope
        test = compiled(rule, scope.key, T.StringType(), inner) if name == "_id" else dated(rule, inner)
        return ~test if node.invert else test
    if not isinstance(t, T.StructType | T.MapType):
        return F.lit(False)
    if node.wild is not None:
        test = _reach(node.wild[0], c, t, lambda x, xt: _resolved(node.wild[1], x, xt, scope.strict()))
        return ~test if node.invert else test
    if out and not node.readings:
        return _resolved(node.exact, *out, scope, node.invert)
    for steps, rule, no in node.readings:
        x: tuple[Column, T.DataType] | None = (c, t)
        for step in steps:
            x = x and (applied(step.name, *x) if step.kind == "transform" else _field(*x, step.name))
        if x:
            return _resolved(rule, *x, scope, node.invert ^ no)
    return F.lit(False)


def dated(node: Node, scope: Scope) -> Column:
    """A rule over the dates: datetimes mean the created date, dates the modified one, text both."""
    if isinstance(node, Junction):
        return reduce(lambda x, y: x & y if node.every else x | y, [dated(n, scope) for n in node.items], F.lit(node.every))
    if isinstance(node, Complement):
        return ~dated(node.item, scope.strict())
    if not isinstance(node, Leaf):
        return F.lit(False)
    arg = node.arg
    probe = next(iter(arg)) if isinstance(arg, tuple | list | set | frozenset) and arg else arg
    strip = lambda x: x.date() if isinstance(x, dt.datetime) else x
    if node.op in ("near", "mod"):
        day = scope.created if isinstance(probe, dt.datetime | float) else scope.modified
        n = F.datediff(day, F.to_date(F.lit("0001-01-01"))) + 1
        if node.op == "near":
            return _held(F.abs(F.datediff(day, F.lit(strip(probe)))) <= arg[1], node.invert)
        return _held(n - F.lit(arg[0]) * F.floor(n / arg[0]) == arg[1], node.invert)
    if isinstance(probe, str | re.Pattern) or node.op in ("re", "re2", "match"):
        return _leaf(node.op, arg, node.invert, F.concat_ws(" ", scope.created.cast("string"), scope.modified.cast("string")), T.StringType(), scope)
    if node.op == "anyin":
        days = [strip(x) for x in arg]
        return _held(scope.created.isin(*days) | scope.modified.isin(*days), node.invert)
    day = scope.created if isinstance(probe, dt.datetime) else scope.modified
    arg = tuple(map(strip, arg)) if isinstance(arg, tuple | list | set | frozenset) else strip(arg)
    return _leaf(node.op, arg, node.invert, day, T.DateType(), scope)


def compiled(node: Node, c: Column, t: T.DataType, scope: Scope) -> Column:
    """A never-null boolean column: whether the value ``c`` of type ``t`` fits the rule."""
    if isinstance(node, Constant):
        return F.lit(node.value)
    if isinstance(node, Junction):
        return reduce(lambda x, y: x & y if node.every else x | y, [compiled(n, c, t, scope) for n in node.items]) if node.items else F.lit(node.every)
    if isinstance(node, Complement):
        return ~compiled(node.item, c, t, scope.strict())
    if isinstance(node, Path):
        return _path(node, c, t, scope)
    if isinstance(node, Apply):
        out = applied(node.op, c, t)
        if not out:
            return F.lit(False)
        test = compiled(node.item, *out, scope.strict() if node.invert else scope)
        return out[0].isNotNull() & ~test if node.invert else test
    if isinstance(node, Index):
        if not isinstance(t, T.ArrayType):
            return F.lit(False)
        x = F.get(c, F.lit(node.at))
        test = compiled(node.item, x, t.elementType, scope.strict() if node.invert else scope)
        return F.coalesce(F.size(c) > node.at, F.lit(False)) & ~test if node.invert else test
    if isinstance(node, Quantified):
        scope = scope.strict()
        if isinstance(t, T.ArrayType | T.StructType | T.MapType):
            test = _below(node.item, c, t, node.every, scope, lambda x, xt: _deep(node.item, x, xt, node.every, scope))
            if isinstance(t, T.StructType):
                own = [(compiled(n, *f, scope), no) for name, n, no in node.named if (f := _field(c, t, name))]
                own_tests = [~x if no else x for x, no in own]
                if own_tests:
                    test = test | reduce(lambda x, y: x & y if node.every else x | y, own_tests)
        else:
            test = compiled(node.item, c, t, scope)
        return ~test if node.invert else test
    return _leaf(node.op, node.arg, node.invert, c, t, scope)
