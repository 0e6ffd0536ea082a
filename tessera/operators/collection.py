"""Collections of keyed records: queries, slices, key-set algebra.

A collection is a DataFrame with an ``_id`` column and the record either in native columns (typed)
or as JSON text in ``_json`` (documents without a schema). Optional columns: ``_row`` (position),
``_cdate`` and ``_mdate``, ``_ver``, ``_flags``, ``_ttl`` (minutes), ``_mts``, ``_group``. Those
that are absent cost nothing: their defaults are literals.
"""

from __future__ import annotations

import datetime as dt
import json
import re
from collections.abc import Callable, Iterable
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.flags import expired, flags_match, mask, parse_flags
from tessera.operators.grouping import grouped, parse_group
from tessera.operators.positions import with_position
from tessera.operators.sorting import sort_keys
from tessera.plans import interpret, native, variant
from tessera.plans.query import Condition, Query
from tessera.plans.row import RowColumns
from tessera.plans.rules import OPERATORS, Junction, Node, parse

META = ("_id", "_row", "_cdate", "_mdate", "_mts", "_ver", "_flags", "_ttl", "_group", "_op")
SEPARATOR = ":::"
RECORDS = "_id string, _row long, _cdate date, _mdate date, _ver long, _flags int, _ttl int, _group string, _json string"


def _today(as_of: Any) -> dt.date:
    return as_of.date() if isinstance(as_of, dt.datetime) else as_of or dt.date.today()


class Collection:
    """A lazy set of records; every method that selects returns another one."""

    def __init__(self, df: DataFrame, as_of: dt.date | dt.datetime | None = None):
        self.df, self.as_of = df, as_of
        self.schemaless = "_json" in df.columns
        hidden = {*META, "_json"}
        self.schema = T.StructType([f for f in df.schema.fields if f.name not in hidden])

    # ---- building -------------------------------------------------------------------------

    @classmethod
    def from_frame(cls, df: DataFrame, key: str | list[str], row: str | Column | None = None, cdate: str | None = None, mdate: str | None = None, as_of: Any = None) -> Collection:
        """A typed collection over a table. ``row`` orders the records (default: the key column as it is)."""
        keys = [key] if isinstance(key, str) else key
        order = F.col(row) if isinstance(row, str) else row if row is not None else F.col(keys[0])
        extra = {"_id": F.concat_ws("|", *[F.col(k).cast("string") for k in keys]), "_row": order.cast("long")}
        if cdate or mdate:
            extra |= {"_cdate": F.to_date(F.col(cdate or mdate)), "_mdate": F.to_date(F.col(mdate or cdate))}
        return cls(df.withColumns(extra), as_of)

    @classmethod
    def from_records(cls, spark: SparkSession, records: dict | Iterable, created: dt.date | None = None, as_of: Any = None, group: str = "") -> Collection:
        """Documents from Python values; a sequence without keys is numbered from 0."""
        day = created or _today(as_of)
        pairs = records.items() if isinstance(records, dict) else ((str(k), v) for k, v in enumerate(records))
        rows = [(str(k), n, day, day, n, 0, 0, group, interpret.json_text(v)) for n, (k, v) in enumerate(pairs)]
        return cls(spark.createDataFrame(rows, RECORDS), as_of)

    def _with(self, df: DataFrame) -> Collection:
        return Collection(df, self.as_of)

    # ---- columns --------------------------------------------------------------------------

    def meta(self, name: str) -> Column:
        if name in self.df.columns:
            return F.col(name)
        day = F.lit(None).cast("date")
        return {"_row": F.lit(0).cast("long"), "_flags": F.lit(0), "_ttl": F.lit(0), "_group": F.lit(""), "_ver": F.lit(0).cast("long"), "_mts": F.lit(None).cast("timestamp_ntz")}.get(name, day)

    def _metas(self) -> dict[str, Column]:
        found = {n: self.meta(n) for n in ("_id", "_row", "_cdate", "_mdate")}
        if "_cdate" in self.df.columns:
            found["_dated"] = F.lit(True)
        return found

    def _scope(self, loose: bool = False) -> native.Scope:
        return native.Scope(self.meta("_id"), self.meta("_cdate"), self.meta("_mdate"), loose)

    def condition(self, rule: Any, loose: bool = False) -> Column:
        """Column of a rule over the records' values; ``loose``: null may stand for False, as in a filter."""
        node = rule if isinstance(rule, Node) else parse(rule)
        if not self.schemaless:
            return native.compiled(node, RowColumns(self.schema), self.schema, self._scope(loose))
        quick = variant.compiled(node, F.parse_json("_json"))
        return quick if quick is not None else self._interpreted(node)

    def _interpreted(self, node: Node) -> Column:
        """The rule over parsed documents, in Arrow batches; one parse serves the whole rule."""

        def run(key: str, text: str, created: dt.date, modified: dt.date) -> bool:
            return text is not None and interpret.matches(node, json.loads(text), interpret.Meta(key, created, modified))

        return F.udf(run, T.BooleanType(), useArrow=True)("_id", "_json", self.meta("_cdate"), self.meta("_mdate"))

    def key_condition(self, rule: Any) -> Column:
        node = rule if isinstance(rule, Node) else parse(rule)
        return native.compiled(node, self.meta("_id"), T.StringType(), self._scope())

    def alive(self, key_flags: str | None = None, with_hidden: bool = False) -> Column | None:
        """Flags and time to live; None where the table has neither."""
        tests = []
        if "_flags" in self.df.columns:
            need, deny = parse_flags(key_flags or "")
            if not with_hidden and not need & mask("h"):
                deny |= mask("h")
            if need or deny:
                tests.append(flags_match(F.col("_flags"), need, deny))
        if "_ttl" in self.df.columns:
            now = self.as_of or dt.datetime.now()
            tests.append(~expired(F.col("_ttl"), self.meta("_mdate"), F.col("_mts") if "_mts" in self.df.columns else None, now))
        out = None
        for t in tests:
            out = t if out is None else out & t
        return out

    # ---- find -----------------------------------------------------------------------------

    def find(self, keys: Any = None, vals: Any = None, date: Any = None, limit: int = 0, skip: int = 0, sort: Any = None, reverse: bool = False, group_by: Any = None, key_flags: str | None = None, with_hidden: bool = False, stats: Observation | None = None, **ops: Any) -> Collection:
        """Records that fit rules on key, value and date.

        ``limit`` and ``skip`` cut the matches in row order, before grouping and sorting (see
        :meth:`top_k` for the other order); of ``group:::key`` each group is cut by itself. Keyword
        arguments are operators (``GT=12``). ``stats`` observes, in the same pass, how many records
        there were, what each filter took and how many matched.
        """
        if isinstance(keys, Condition):
            keys, vals = None, keys
        rule = _value_rule(vals)
        for name, arg in ops.items():
            if name.lower() not in OPERATORS:
                raise TypeError(f"unknown argument {name!r}")
            rule = {**(rule or {}), f"${name.lower()}": arg}
        if isinstance(rule, dict):
            rule = dict(rule)
            if "_id" in rule and keys is None:
                keys = {"__rule__": rule.pop("_id")}
            if "_date" in rule and date is None:
                date = {"__rule__": rule.pop("_date")}
        df = self.df
        if isinstance(keys, str) and SEPARATOR in keys:
            group, _, keys = keys.rpartition(SEPARATOR)
            df = df.where(self.meta("_group").rlike(group) if group else self.meta("_group") != "")
            found = self._with(df).find(keys or None, rule, date, key_flags=key_flags, with_hidden=with_hidden, stats=stats)
            if limit or skip:
                found = found._with(_cut_groups(found.df, found.meta("_group"), found.meta("_row"), limit, skip))
            return found._arranged(group_by, sort, reverse)
        key_rule = _key_rule(keys)
        alive = self.alive(key_flags, with_hidden)
        tests = {
            "key_filter": None if key_rule is None else self.key_condition(key_rule),
            "flag_filter": alive,
            "date_filter": None if date is None else native.dated(_date_rule(date, self.as_of), self._scope()),
            "value_filter": None if rule is None else self.condition(rule, loose=True),
        }
        if stats is not None:
            df = df.observe(stats, *_counts(tests))
        for test in tests.values():
            df = df if test is None else df.where(test)
        if limit:
            df = df.orderBy(self.meta("_row"))
            df = (df.offset(skip) if skip else df).limit(limit)
        elif skip:  # what follows can be everything: numbered in ranges, not in one task
            order = df.withColumn("__order", self.meta("_row"))
            df = with_position(order, "__order", "__at").where(F.col("__at") >= skip).drop("__order", "__at")
        return self._with(df)._arranged(group_by, sort, reverse)

    def _arranged(self, group_by: Any, sort: Any, reverse: bool) -> Collection:
        found = self if group_by is None else self.group_by(group_by)
        return found.sort(sort, reverse) if sort is not None else found

    def group_by(self, spec: Any) -> Collection:
        """Groups in order of first appearance."""
        typed = self.typed() if self.schemaless else self
        return Collection(grouped(typed.df, parse_group(spec), RowColumns(typed.schema), typed.schema, typed._metas()), self.as_of)

    def sort(self, spec: Any, reverse: bool = False) -> Collection:
        typed = self.typed() if self.schemaless else self
        meta = typed._metas()
        if "_id" not in typed.df.columns:
            meta["_id"] = F.lit("")
        return typed._with(typed.df.orderBy(*sort_keys(spec, reverse, RowColumns(typed.schema), typed.schema, meta)))

    def top_k(self, spec: Any, k: int, reverse: bool = False) -> Collection:
        """First ``k`` records of the sorted order (an extension; ``find`` limits before it sorts)."""
        found = self.sort(spec, reverse)
        return found._with(found.df.limit(k))

    def typed(self, schema: T.StructType | None = None) -> Collection:
        """Documents as native columns; the schema is taken from the documents unless given."""
        if not self.schemaless:
            return self
        if schema is None:
            text = self.df.select(F.schema_of_variant_agg(F.parse_json("_json"))).first()[0]
            schema = T.StructType.fromDDL(_object_ddl(text)) if text and text.startswith("OBJECT") else T.StructType([T.StructField("_val", T.StringType())])
        kept = [c for c in self.df.columns if c != "_json"]
        if schema.names == ["_val"]:
            return self._with(self.df.select(*kept, F.col("_json").alias("_val")))
        parsed = self.df.withColumn("__d", F.from_json("_json", schema))
        return self._with(parsed.select(*kept, *[F.col("__d").getField(n).alias(n) for n in schema.names]))

    def map(self, func: Callable, schema: str, keys: Any = None, vals: Any = None, date: Any = None) -> DataFrame:
        """``func(key, value)`` of each record as column ``out`` of type ``schema``, in Arrow batches."""
        found = self.find(keys, vals, date, with_hidden=True)
        if found.schemaless:
            call = F.udf(lambda k, t: func(k, json.loads(t)), schema, useArrow=True)
            return found.df.select("_id", call("_id", "_json").alias("out"))
        call = F.udf(lambda k, r: func(k, r.asDict(recursive=True) if hasattr(r, "asDict") else r), schema, useArrow=True)
        return found.df.select("_id", call("_id", RowColumns(self.schema).whole()).alias("out"))

    def show(self, *args: Any, limit: int = 50, **kwargs: Any) -> Collection:
        """Print the matches as a table and return them."""
        found = self.find(*args, limit=limit, **kwargs)
        found.typed().df.drop("_row", "_ver", "_flags", "_ttl", "_group").show(limit, truncate=40)
        return found

    # ---- reading --------------------------------------------------------------------------

    def _value(self, row: Any) -> Any:
        if self.schemaless:
            return json.loads(row["_json"])
        out = row.asDict(recursive=True)
        return {n: out[n] for n in self.schema.names}

    def to_dict(self) -> dict[str, Any]:
        """All records on the driver, in row order (for results known to be small)."""
        return {r["_id"]: self._value(r) for r in self.df.orderBy(self.meta("_row")).collect()}

    def get(self, key: str, default: Any = None) -> Any:
        rows = self._with(self.df.where(F.col("_id") == key)).df.limit(1).collect()
        return self._value(rows[0]) if rows else default

    def get_n(self, keys: Iterable[str]) -> Collection:
        return self._with(self.df.where(F.col("_id").isin(*keys)))

    def get_all(self) -> Collection:
        return self

    def ids(self) -> DataFrame:
        return self.df.select("_id")

    def values(self) -> DataFrame:
        return self.df.orderBy(self.meta("_row")).select("_json" if self.schemaless else RowColumns(self.schema).whole().alias("value"))

    def count(self) -> int:
        return self.df.count()

    __len__ = count

    def has(self, key: Any) -> bool:
        """Whether a key, every key of a set, or any record of a condition is there."""
        if isinstance(key, Condition | dict):
            return not self.find(vals=key).df.isEmpty()
        wanted = {key} if isinstance(key, str) else set(key)
        return self.has_all(wanted)

    __contains__ = has

    def has_any(self, keys: Any) -> bool:
        return not self._ids_of(keys).join(self.ids(), "_id", "left_semi").isEmpty()

    def has_all(self, keys: Any) -> bool:
        return self._ids_of(keys).join(self.ids(), "_id", "left_anti").isEmpty()

    def info(self) -> DataFrame:
        """Counts and ranges over the records' metadata."""
        return self.df.agg(
            F.count("*").alias("records"),
            F.min(self.meta("_cdate")).alias("first_created"),
            F.max(self.meta("_mdate")).alias("last_modified"),
            F.max(self.meta("_ver")).alias("version"),
            F.count_if(self.meta("_ttl") > 0).alias("expiring"),
        )

    # ---- selectors and slices ----------------------------------------------------------------

    def __getitem__(self, sel: Any) -> Any:
        return self.select(sel)

    def select(self, sel: Any) -> Any:
        """Records by key, condition, pattern, callable, date, slice or keys."""
        if isinstance(sel, str) and SEPARATOR in sel:
            return self.find(sel, with_hidden=True)
        if isinstance(sel, str):
            return self.get(sel)
        if isinstance(sel, bytes):
            return self.get(sel.decode())
        if isinstance(sel, Condition | dict):
            return self.find(vals=sel, with_hidden=True)
        if isinstance(sel, dt.datetime):
            return self._with(self.df.where(self.meta("_cdate") == sel.date()))
        if isinstance(sel, dt.date):
            return self._with(self.df.where(self.meta("_mdate") == sel))
        if isinstance(sel, re.Pattern):
            return self.find(keys=sel, with_hidden=True)
        if isinstance(sel, slice):
            return self.slice(sel)
        if isinstance(sel, int):
            return self.rows(sel, sel + 1 if sel != -1 else None)
        if isinstance(sel, float):
            return self._with(self.df.where(self.meta("_ver") == int(sel)))
        if callable(sel):
            return self.find(keys=sel, with_hidden=True) if sel.__code__.co_argcount == 1 else self.find(vals=sel, with_hidden=True)
        if isinstance(sel, Collection):
            return self._with(self.df.join(sel.ids().distinct(), "_id", "left_semi"))
        return self.get_n(sel)

    def slice(self, s: slice) -> Collection:
        """Half-open ranges: rows by integers, versions by floats, days by dates (datetimes: created)."""
        ends = [x for x in (s.start, s.stop) if x is not None]
        if isinstance(s.step, str | re.Pattern):
            rule = {"$re": s.step}
            return self.slice(slice(s.start, s.stop)).find(keys={"__rule__": rule}, with_hidden=True)
        if isinstance(s.step, Condition | dict):
            return self.slice(slice(s.start, s.stop)).find(vals=s.step, with_hidden=True)
        if any(isinstance(x, dt.date) for x in ends):
            day = self.meta("_cdate") if any(isinstance(x, dt.datetime) for x in ends) else self.meta("_mdate")
            plain = [x.date() if isinstance(x, dt.datetime) else x for x in (s.start, s.stop)]
            df = self.df
            df = df.where(day >= F.lit(plain[0])) if plain[0] else df
            return self._with(df.where(day < F.lit(plain[1])) if plain[1] else df)
        if any(isinstance(x, float) for x in ends):
            return self.versions(s.start, s.stop)
        return self.rows(s.start, s.stop, s.step)

    def versions(self, low: float | None, high: float | None) -> Collection:
        """Records written in a range of the write counter; negative bounds count from the latest."""
        df, ver = self.df, self.meta("_ver")
        if any(x is not None and x < 0 for x in (low, high)):
            top = (df.agg(F.max(ver)).first()[0] or 0) + 1
            low, high = (top + x if x is not None and x < 0 else x for x in (low, high))
        df = df.where(ver >= int(low)) if low is not None else df
        return self._with(df.where(ver < int(high)) if high is not None else df)

    def rows(self, start: int | None, stop: int | None, step: int | None = None) -> Collection:
        """Records by position in row order, with Python's slice rules."""
        step = step or 1
        if step == 1 and (start or 0) >= 0 and (stop is None or stop >= 0):
            df = self.df.orderBy(self.meta("_row")).offset(start or 0)
            return self._with(df if stop is None else df.limit(max(0, stop - (start or 0))))
        n = self.count()
        low, high, step = slice(start, stop, step).indices(n)
        placed = with_position(self.df, "_row", "__at", n)
        if step < 0:
            low, high = low, high
            test = (F.col("__at") <= low) & (F.col("__at") > high) & ((low - F.col("__at")) % -step == 0)
        else:
            test = (F.col("__at") >= low) & (F.col("__at") < high) & ((F.col("__at") - low) % step == 0)
        return self._with(placed.where(test).drop("__at"))

    # ---- key-set algebra ----------------------------------------------------------------------

    def _ids_of(self, other: Any) -> DataFrame:
        if isinstance(other, Collection):
            return other.ids().distinct()
        if isinstance(other, DataFrame):
            return other.select(other[other.columns[0]].cast("string").alias("_id")).distinct()
        keys = [other] if isinstance(other, str) else list(other)
        return self.df.sparkSession.createDataFrame([(str(k),) for k in keys], "_id string").distinct()

    def intersection(self, other: Any) -> DataFrame:
        return self.ids().distinct().join(self._ids_of(other), "_id", "left_semi")

    def union(self, other: Any) -> DataFrame:
        return self.ids().union(self._ids_of(other)).distinct()

    def difference(self, other: Any) -> DataFrame:
        return self.ids().distinct().join(self._ids_of(other), "_id", "left_anti")

    def non_joint(self, other: Any) -> DataFrame:
        """Keys of ``other`` that are not here."""
        return self._ids_of(other).join(self.ids(), "_id", "left_anti")

    def symmetric_difference(self, other: Any) -> DataFrame:
        both = self.ids().distinct().withColumn("l", F.lit(1)).join(self._ids_of(other).withColumn("r", F.lit(1)), "_id", "full_outer")
        return both.where("l is null or r is null").select("_id")

    joint, non_intersection = intersection, symmetric_difference
    __and__ = __rand__ = intersection
    __or__ = __ror__ = __add__ = __radd__ = union
    __sub__, __rsub__ = difference, non_joint
    __xor__ = __rxor__ = symmetric_difference

    def is_superset(self, other: Any) -> bool:
        return self.non_joint(other).isEmpty()

    def is_subset(self, other: Any) -> bool:
        return self.difference(other).isEmpty()

    def is_disjoint(self, other: Any) -> bool:
        return self.intersection(other).isEmpty()

    def same_as(self, other: Collection | dict) -> bool:
        """Whether both hold the same keys with the same values."""
        if isinstance(other, dict):
            other = Collection.from_records(self.df.sparkSession, other)
        a, b = (c.df.select("_id", _canonical(c).alias("v")) for c in (self, other))
        joined = a.withColumn("l", F.lit(1)).join(b.select("_id", F.col("v").alias("w"), F.lit(1).alias("r")), "_id", "full_outer")
        return joined.where("l is null or r is null or not (v <=> w)").isEmpty()


def _cut_groups(df: DataFrame, group: Column, row: Column, limit: int, skip: int) -> DataFrame:
    """Each group's matches from ``skip`` on, ``limit`` of them; a limit is pushed below the shuffle."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(row))
    numbered = df.withColumn("__n", place)
    numbered = numbered.where(F.col("__n") <= skip + limit) if limit else numbered
    return numbered.where(F.col("__n") > skip).drop("__n")


def _counts(tests: dict[str, Column | None]) -> list[Column]:
    """Counts of all records, of those that each filter takes from what the ones before left, and of matches."""
    left, out = F.lit(True), [F.count("*").alias("records")]
    for name, test in tests.items():
        passed = left if test is None else left & F.coalesce(test, F.lit(False))
        out.append((F.count_if(left) - F.count_if(passed)).alias(name))
        left = passed
    return [*out, F.count_if(left).alias("matched")]


def _canonical(c: Collection) -> Column:
    text = F.col("_json") if c.schemaless else F.to_json(RowColumns(c.schema).whole())
    return F.to_json(F.parse_json(text))


def _object_ddl(text: str) -> str:
    """DDL of a document schema: OBJECT<...> and names become a struct's, VOID and VARIANT text."""
    body = text.removeprefix("OBJECT<").removesuffix(">")
    return re.sub(r"OBJECT<", "STRUCT<", body).replace("VOID", "STRING").replace("VARIANT", "STRING")


def _value_rule(vals: Any) -> Any:
    if vals is None:
        return None
    if isinstance(vals, Condition):
        return dict(vals.as_rule())
    if isinstance(vals, dict):
        return dict(vals)
    if isinstance(vals, re.Pattern):
        return {"$re": vals}
    if isinstance(vals, list | set | tuple | frozenset | range):
        return {"$in": tuple(vals)}
    return {"$func": vals} if callable(vals) else {"$eq": vals}


def _key_rule(keys: Any) -> Node | None:
    if keys is None or keys == "":
        return None
    if isinstance(keys, dict) and "__rule__" in keys:
        return parse(keys["__rule__"])
    if isinstance(keys, Condition | dict):
        return parse(keys)
    if isinstance(keys, str):
        return parse({"$re": keys})
    if isinstance(keys, re.Pattern):
        return parse(keys)
    if isinstance(keys, bytes):
        return parse(keys.decode())
    if callable(keys) and not isinstance(keys, Query):
        return parse({"$func": keys})
    if isinstance(keys, int | float | dt.date):
        return parse(str(keys))
    return parse({"$in": tuple(map(str, keys))})


def _date_rule(date: Any, as_of: Any) -> Node:
    if isinstance(date, dict):
        return parse(date["__rule__"] if "__rule__" in date else date)
    if isinstance(date, bool):
        return Junction(True, ())
    if isinstance(date, int | float):
        today = _today(as_of)
        other = today + dt.timedelta(days=int(date))
        low, high = min(today, other), max(today, other)
        if isinstance(date, float):
            low, high = (dt.datetime(d.year, d.month, d.day) for d in (low, high))
        return parse({"$eq": today} if date == 0 else {"$between": (low, high)})
    if isinstance(date, str):
        return parse({"$has": date})
    if isinstance(date, set | list | tuple | frozenset):
        return parse({"$anyin": tuple(date)})
    return parse(date)
