"""The 23 value transforms as column expressions, and as aggregates over groups."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
Typed = tuple[Column, T.DataType]
_INT, _FLOAT = r"^\s*[+-]?\d+\s*$", r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def is_number(t: T.DataType) -> bool:
    return isinstance(t, NUMERIC)


def as_number(c: Column, t: T.DataType) -> Typed:
    """Booleans count as 0 and 1."""
    return (c.cast("int"), T.IntegerType()) if isinstance(t, T.BooleanType) else (c, t)


def number_text(c: Column, t: T.DataType) -> Column:
    """Python's text of a value: True, 1, 1.0."""
    if isinstance(t, T.BooleanType):
        return F.when(c, "True").when(~c, "False")
    if isinstance(t, T.FloatType | T.DoubleType):
        d = c.cast("double")
        plain = F.regexp_replace(d.cast("decimal(38,18)").cast("string"), "0+$", "")
        plain = F.when(plain.endswith("."), F.concat(plain, F.lit("0"))).otherwise(plain)
        return F.when((F.abs(d) < 1e16) & ((F.abs(d) >= 1e-4) | (d == 0)), plain).otherwise(d.cast("string"))
    return c.cast("string")


def _each(op: str, c: Column, t: T.ArrayType) -> Typed | None:
    out = scalar(op, F.lit(None).cast(t.elementType), t.elementType)
    if out is None:
        return None
    return F.transform(c, lambda x: scalar(op, x, t.elementType)[0]), T.ArrayType(out[1])


def scalar(op: str, c: Column, t: T.DataType) -> Typed | None:
    """A transform of one scalar; None where the type does not allow it."""
    text, number, flag = isinstance(t, T.StringType), is_number(t), isinstance(t, T.BooleanType)
    long, double = T.LongType(), T.DoubleType()
    if op in ("lower", "upper", "strip"):
        if not text:
            return None
        return (F.regexp_replace(c, r"(?U)^\s+|\s+$", "") if op == "strip" else getattr(F, op)(c)), t
    if op == "len":
        return (F.length(c), T.IntegerType()) if isinstance(t, T.StringType | T.BinaryType) else None
    if op in ("first", "last"):
        return (F.left(c, F.lit(1)) if op == "first" else F.right(c, F.lit(1)), t) if text else None
    if op in ("avg", "max", "min", "sum", "mid"):
        if text and op == "avg":
            return None
        return (c.cast("double"), double) if op == "avg" and number else (c, t)
    if op == "std":
        return F.when(c.isNotNull(), F.lit(0.0)), double
    if op == "str":
        return (c, t) if text else (number_text(c, t), T.StringType()) if number or flag else None
    if op == "float":
        value = F.when(c.rlike(_FLOAT), c.try_cast("double")) if text else c.cast("double")
        return (value, double) if text or number or flag else None
    if op == "int":
        value = F.when(c.rlike(_INT), c.try_cast("bigint")) if text else c.cast("bigint")
        return (value, long) if text or number or flag else None
    if text and op in ("ceil", "floor", "round", "neg"):
        c, t, number = F.when(c.rlike(_FLOAT), c.try_cast("double")), double, True
    if flag:
        c, t, number = c.cast("int"), T.IntegerType(), True
    if not number:
        return None
    if op == "abs":
        return F.abs(c), t
    if op == "neg":
        return F.negative(c), t
    if op in ("ceil", "floor", "round"):
        if isinstance(t, WHOLE):
            return c, t
        return {"ceil": F.ceil, "floor": F.floor, "round": F.bround}[op](c).cast("bigint"), long
    return None


def _sum(c: Column, t: T.ArrayType) -> Column:
    zero, kind = (F.lit(0).cast("bigint"), "bigint") if isinstance(t.elementType, (*WHOLE, T.BooleanType)) else (F.lit(0.0), "double")
    return F.aggregate(c, zero, lambda a, x: a + (x.cast("int").cast(kind) if isinstance(t.elementType, T.BooleanType) else x.cast(kind)))


def applied(op: str, c: Column, t: T.DataType) -> Typed | None:
    """A transform of any value; None where the type does not allow it."""
    if not isinstance(t, T.ArrayType):
        if op == "unique" and isinstance(t, T.MapType | T.StructType):
            return c, t
        if isinstance(t, T.MapType) and op == "len":
            return F.size(c), T.IntegerType()
        if isinstance(t, T.StructType):
            return (F.when(c.isNotNull(), F.lit(len(t))), T.IntegerType()) if op == "len" else None
        return scalar(op, c, t)
    e = t.elementType
    summable = is_number(e) or isinstance(e, T.BooleanType)
    if op == "len":
        return F.size(c), T.IntegerType()
    if op == "first":
        return F.get(c, F.lit(0)), e
    if op == "last":
        return F.try_element_at(c, F.lit(-1)), e
    if op == "mid":
        return F.get(c, F.floor(F.size(c) / 2).cast("int")), e
    if op in ("max", "min"):
        # A null element has no order: the whole is undefined, as with mixed kinds.
        whole = (F.array_max if op == "max" else F.array_min)(c)
        return F.when(~F.exists(c, lambda x: x.isNull()), whole), e
    if op == "sort":
        return F.when(~F.exists(c, lambda x: x.isNull()), F.array_sort(c)), t
    if op == "unique":
        return F.array_distinct(c), t
    if op == "flat":
        return (F.flatten(c), e) if isinstance(e, T.ArrayType) else (c, t)
    if op in ("sum", "avg", "std"):
        if not summable:
            return None
        total, n = _sum(c, t), F.size(c)
        if op == "sum":
            return total, T.LongType() if isinstance(e, (*WHOLE, T.BooleanType)) else T.DoubleType()
        mean = F.when(n > 0, total / n)
        if op == "avg":
            return mean, T.DoubleType()
        spread = F.aggregate(c, F.lit(0.0), lambda a, x: a + (x.cast("double") - mean) * (x.cast("double") - mean))
        return F.when(n > 0, F.sqrt(spread / n)), T.DoubleType()
    return _each(op, c, t)


def ordered_list(c: Column, row: Column) -> Column:
    """Present values of a group in row order."""
    pairs = F.collect_list(F.when(c.isNotNull(), F.struct(row.alias("r"), c.alias("v"))))
    return F.transform(F.array_sort(pairs), lambda x: x["v"])


def aggregated(op: str, c: Column, t: T.DataType, row: Column) -> Column:
    """A transform as the aggregate of a group; ``row`` gives the order of its members.

    Sums, means, extremes and counts aggregate partially before the shuffle. Those that need the
    members themselves gather one group's values, as their result does.
    """
    number = is_number(t) or isinstance(t, T.BooleanType)
    n = as_number(c, t)[0]
    none = F.max(F.lit(None).cast("double"))
    if op == "len":
        return F.count(c)
    if op == "sum":
        zero = F.lit(0) if isinstance(t, (*WHOLE, T.BooleanType)) else F.lit(0.0)
        return F.coalesce(F.sum(n), zero) if number else F.when(F.count(c) == 0, F.lit(0)).cast("bigint")
    if op == "avg":
        return F.avg(n) if number else none
    if op == "std":
        return F.stddev_pop(n) if number else none
    if op in ("max", "min"):
        return (F.max if op == "max" else F.min)(c)
    if op in ("first", "last"):
        pick = F.min_by if op == "first" else F.max_by
        return pick(c, F.when(c.isNotNull(), row))
    held = ordered_list(c, row)
    if op == "list":
        return held
    out = applied(op, held, T.ArrayType(t))
    return out[0] if out else F.max(F.lit(None).cast(T.ArrayType(t)))
