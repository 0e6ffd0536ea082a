"""Writable collections over an append-only version log.

Every write appends versions (``_ver`` counts record writes); a delete appends a tombstone. The
live view is the newest version of each key: one partial aggregation. Undo appends the version
before, so it can itself be undone; nothing is ever rewritten in place, and a log written as
Parquet can be read as of any version.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.documents import grown, merged
from tessera.functions.flags import expired, mask, ttl_minutes
from tessera.operators.collection import Collection
from tessera.operators.positions import with_position
from tessera.plans import interpret
from tessera.plans.storage import cut

LOG = "_group string, _id string, _ver long, _op string, _row long, _cdate date, _mdate date, _ttl int, _flags int, _json string"
COLUMNS = [part.split()[0] for part in LOG.split(", ")]
PUT, DELETE = "put", "del"
KEY = ["_group", "_id"]


def empty_log(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], LOG)


def latest(log: DataFrame, version: int | None = None) -> DataFrame:
    """The newest version of each key, tombstones included, as of ``version`` (exclusive)."""
    df = log if version is None else log.where(F.col("_ver") < version)
    rest = [c for c in df.columns if c not in KEY]
    newest = df.groupBy(*KEY).agg(F.max_by(F.struct(*rest), "_ver").alias("v"))
    return newest.select(*KEY, *[F.col(f"v.{c}").alias(c) for c in rest]).select(*df.columns)


def live(log: DataFrame, version: int | None = None) -> DataFrame:
    return latest(log, version).where(F.col("_op") == PUT)


def nth_latest(log: DataFrame, n: int) -> DataFrame:
    """The n-th newest version of each key (1 is the live one), keeping only n per key on the way."""
    rest = [c for c in log.columns if c not in KEY]
    top = log.groupBy(*KEY).agg(F.slice(F.sort_array(F.collect_list(F.struct("_ver", *[c for c in rest if c != "_ver"])), asc=False), 1, n).alias("v"))
    top = top.where(F.size("v") >= n).withColumn("x", F.element_at("v", n))
    return top.select(*KEY, *[F.col(f"x.{c}").alias(c) for c in rest]).select(*log.columns)


class Store:
    """A collection that can be written. ``as_of`` stands in for today where it is given."""

    def __init__(self, spark: SparkSession, log: DataFrame | None = None, group: str = "", as_of: dt.date | dt.datetime | None = None, check: Callable[[str, Any], bool] | None = None, every: int = 20):
        self.spark, self.group, self.as_of, self.check = spark, group, as_of, check
        self.log = empty_log(spark) if log is None else log
        self._writes, self._every, self._next = 0, every, None

    # ---- views ----------------------------------------------------------------------------

    @property
    def today(self) -> dt.date:
        now = self.as_of
        return now.date() if isinstance(now, dt.datetime) else now or dt.date.today()

    def version(self) -> int:
        """The next value of the write counter; read from the log once, then kept."""
        if self._next is None:
            self._next = (self.log.agg(F.max("_ver")).first()[0] or 0) + 1
        return self._next

    def records(self, version: int | None = None) -> DataFrame:
        return live(self.log, version).where(F.col("_group") == self.group)

    def view(self, version: int | None = None) -> Collection:
        """The live records, or those as of a version, as a collection."""
        return Collection(self.records(version).drop("_op"), self.as_of)

    def all_groups(self) -> Collection:
        """Live records of every group, for ``group:::key`` queries."""
        return Collection(live(self.log).drop("_op"), self.as_of)

    def to_dict(self) -> dict[str, Any]:
        return self.view().to_dict()

    # ---- appending ------------------------------------------------------------------------

    def _append(self, rows: DataFrame) -> int:
        """Number ``rows`` by ``_row`` and append them; returns how many."""
        base = self.version()
        rows = cut(rows.drop("_ver"))  # computed once: numbering reads it several times
        n = rows.count()
        rows = cut(with_position(rows, "_row", "_ver", n).withColumn("_ver", F.col("_ver") + base).select(*COLUMNS))
        self.log, self._next = self.log.unionByName(rows), base + n
        self._writes += 1
        if self._writes % self._every == 0:
            self.log = cut(self.log)
        return n

    def frame(self, data: Any) -> DataFrame:
        """(``_id``, ``_json``, ``_row``) of incoming data: a mapping, a sequence, a collection or a DataFrame."""
        if isinstance(data, Store):
            data = data.view()
        if isinstance(data, Collection):
            text = F.col("_json") if data.schemaless else F.to_json(F.struct(*data.schema.names))
            return data.df.select("_id", text.alias("_json"), data.meta("_row").alias("_row"))
        if isinstance(data, DataFrame):
            values = [c for c in data.columns if c != "_id"]
            text = F.col("_json") if "_json" in values else F.to_json(F.struct(*values))
            return data.select("_id", text.alias("_json"), F.monotonically_increasing_id().alias("_row"))
        if not isinstance(data, dict):
            base = self.version()
            data = {str(base + k): v for k, v in enumerate(data)}
        rows = [(str(k), interpret.json_text(v), n) for n, (k, v) in enumerate(data.items())]
        return self.spark.createDataFrame(rows, "_id string, _json string, _row long")

    def _write(self, data: Any, new: bool, old: bool, ttl: Any = None, flags: str = "") -> int:
        """Append what changes; ``new`` and ``old`` say whether absent and present keys are written.

        Equal values are no change. Read-only records stay; append-only ones accept only longer
        values that keep what is there.
        """
        fresh = self.frame(data).alias("n")
        now = self.records()
        if isinstance(data, dict | list):  # a few keys: only their versions are aggregated
            now = now.join(F.broadcast(fresh.select("_id")), "_id", "left_semi")
        now = now.select("_id", *[F.col(f"_{c}").alias(f"o_{c}") for c in self._OLD])
        both = fresh.join(now, "_id", "left")
        return self._put(both.where(F.when(F.col("o_row").isNotNull(), F.lit(old)).otherwise(F.lit(new))), ttl, flags)

    _OLD = ("json", "row", "cdate", "ttl", "flags")

    def _change(self, rows: DataFrame, text: Column) -> int:
        """Write new values of live rows; what they were is at hand, so nothing is looked up."""
        return self._put(rows.select("_id", text.alias("_json"), "_row", *[F.col(f"_{c}").alias(f"o_{c}") for c in self._OLD]))

    def _put(self, both: DataFrame, ttl: Any = None, flags: str = "") -> int:
        """Append the values of ``both(_id, _json, _row, o_*)`` that differ and may be written; ``o_*`` is the live record."""
        day = F.lit(self.today)
        locked = F.coalesce(F.col("o_flags").bitwiseAND(mask("r")) != 0, F.lit(False))
        tail = F.coalesce(F.col("o_flags").bitwiseAND(mask("a")) != 0, F.lit(False))
        both = both.where(~locked & ~F.col("o_json").eqNullSafe(F.col("_json")))
        both = both.where(F.when(tail, grown(F.col("o_json"), F.col("_json"))).otherwise(True))
        if self.check is not None:
            test = self.check
            both = both.where(F.udf(lambda k, t: bool(test(k, json.loads(t))), T.BooleanType(), useArrow=True)("_id", "_json"))
        bits, minutes = mask(flags), ttl_minutes(ttl)
        rows = both.select(
            F.lit(self.group).alias("_group"), "_id", F.lit(PUT).alias("_op"), F.coalesce("o_row", F.lit(1 << 40) * F.lit(self._writes + 1) + F.col("_row")).alias("_row"),
            F.coalesce("o_cdate", day).alias("_cdate"), day.alias("_mdate"), (F.lit(minutes) if ttl is not None else F.coalesce("o_ttl", F.lit(0))).alias("_ttl"),
            F.coalesce("o_flags", F.lit(0)).bitwiseOR(bits).alias("_flags"), "_json",
        )
        return self._append(rows)

    def update(self, data: Any, **kw: Any) -> int:
        """Insert or replace; returns how many records changed."""
        return self._write(data, new=True, old=True, **kw)

    def insert(self, data: Any, **kw: Any) -> int:
        return self._write(data, new=True, old=False, **kw)

    def replace(self, data: Any, **kw: Any) -> int:
        return self._write(data, new=False, old=True, **kw)

    def append(self, values: list, **kw: Any) -> int:
        """Add values under keys taken from the write counter."""
        return self._write(list(values), new=True, old=False, **kw)

    def set(self, key: str, value: Any, **kw: Any) -> bool:
        if callable(value):
            return self.add({key: value}, **kw).count() > 0
        return self._write({key: value}, new=True, old=True, **kw) > 0

    def add(self, records: Any, default: Any = None, replace: bool = True, insert: bool = True, flags: str = "") -> Collection:
        """Write and return the records that changed.

        A value of None stands for ``default``; a callable is called with the key and the old value
        (None for a new key). A list is written under keys from the write counter.
        """
        if isinstance(records, dict):
            calls = {str(k): v for k, v in records.items() if callable(v)}
            if any(f.__code__.co_argcount != 2 for f in calls.values()):
                raise TypeError("a callable value takes the key and the old value")
            old = self.view().get_n(calls).to_dict() if calls else {}
            records = {str(k): calls[str(k)](str(k), old.get(str(k))) if str(k) in calls else default if v is None else v for k, v in records.items()}
        base = self.version()
        self._write(records, new=insert, old=replace, flags=flags)
        return Collection(self.records().where(F.col("_ver") >= base).drop("_op"), self.as_of)

    def set_n(self, records: dict[str, Any], **kw: Any) -> bool:
        """Set several keys; whether any changed."""
        return self._write(records, new=True, old=True, **kw) > 0

    def setdefault(self, key: str, value: Any) -> bool:
        return self._write({key: value}, new=True, old=False) > 0

    def _selected(self, sel: Any) -> DataFrame:
        """Live log rows of a selection: keys, a condition, a callable or a collection."""
        if isinstance(sel, str) and ":::" not in sel:
            return self.records().where(F.col("_id") == sel)
        if isinstance(sel, slice) and sel == slice(None):
            return self.records()
        found = sel if isinstance(sel, Collection) else self.view().select(sel)
        # The keys are written first: a join of the log's union with itself trips the optimizer.
        return self.records().join(cut(found.df.select("_id").distinct()), "_id", "left_semi").select(*COLUMNS)

    def assign(self, sel: Any, value: Any) -> int:
        """Set every selected record to a value, or to ``value(key, old)``."""
        rows = self._selected(sel)
        if callable(value):
            text = F.udf(lambda k, t: interpret.json_text(value(k, json.loads(t))), "string", useArrow=True)("_id", "_json")
        else:
            text = F.lit(interpret.json_text(value))
        if isinstance(sel, str) and not callable(value):
            return self.update({sel: value})
        return self._change(rows, text)

    __setitem__ = assign

    def update_if(self, condition: Any, patch: dict | Callable) -> int:
        """Merge a patch into matching mappings. A None in the patch removes that field; a patch
        function that returns None deletes the record."""
        rows = self.view().find(vals=condition, with_hidden=True).df
        if not callable(patch):
            return self._change(rows, merged(F.col("_json"), patch))

        def changed(key: str, text: str) -> str | None:
            value = json.loads(text)
            if not isinstance(value, dict):
                return text
            change = patch(key, value)
            if change is None:
                return None
            return interpret.json_text({k: v for k, v in {**value, **change}.items() if v is not None or k not in change})

        rows = cut(rows.withColumn("__new", F.udf(changed, "string", useArrow=True)("_id", "_json")))
        gone = self._remove(rows.where("__new is null").select("_id"))
        return gone + self._change(rows.where("__new is not null"), F.col("__new"))

    def _remove(self, keys: DataFrame) -> int:
        rows = self.records().join(keys.distinct(), "_id", "left_semi")
        rows = rows.where(F.col("_flags").bitwiseAND(mask("r") | mask("p")) == 0)
        return self._append(rows.select(*[F.lit(DELETE).alias("_op") if c == "_op" else F.lit(self.today).alias("_mdate") if c == "_mdate" else F.col(c) for c in COLUMNS]))

    def remove(self, sel: Any) -> int:
        """Delete a selection; returns how many went."""
        return self._remove(self._selected(sel).select("_id"))

    __delitem__ = remove

    def pop(self, key: str, default: Any = None) -> Any:
        value = self.view().get(key, default)
        self.remove(key)
        return value

    def clear(self, agree: str = "") -> int:
        """Delete everything; only if ``agree`` is 'yes'."""
        return self._remove(self.records().select("_id")) if agree == "yes" else 0

    def reinit(self, data: Any) -> int:
        self.clear("yes")
        return self.update(data)

    def rename(self, names: dict[str, str]) -> int:
        """Change keys; a key that is taken is left alone."""
        pairs = self.spark.createDataFrame(list(names.items()), "_id string, new string")
        free = pairs.join(self.records().select(F.col("_id").alias("new")), "new", "left_anti")
        rows = cut(self.records().join(free, "_id"))
        made = self._append(rows.drop("_id").withColumnRenamed("new", "_id").select(*COLUMNS))
        self._remove(rows.select("_id"))
        return made

    # ---- dates, flags, links, groups -----------------------------------------------------------

    def set_date(self, sel: Any, cdate: dt.date | None = None, mdate: dt.date | None = None, ttl: Any = None) -> int:
        change = {"_cdate": cdate, "_mdate": mdate, "_ttl": None if ttl is None else ttl_minutes(ttl)}
        rows = self._selected(sel)
        return self._append(rows.select(*[F.lit(change[c]).alias(c) if change.get(c) is not None else F.col(c) for c in COLUMNS]))

    def set_flags(self, sel: Any, letters: str) -> int:
        """``'+r-h'``: set and clear stored flags."""
        from tessera.functions.flags import parse_flags

        on, off = parse_flags(letters)
        rows = self._selected(sel)
        bits = F.col("_flags").bitwiseOR(on).bitwiseAND(~off)
        return self._append(rows.select(*[bits.alias(c) if c == "_flags" else F.col(c) for c in COLUMNS]))

    def get_flags(self, sel: Any = slice(None)) -> DataFrame:
        return self._selected(sel).select("_id", "_flags", "_ttl")

    def set_link(self, key: str, target: str) -> int:
        """Make ``key`` stand for another record; a link to a link is refused."""
        linked = self.records().where((F.col("_id") == target) & (F.col("_flags").bitwiseAND(mask("l")) != 0))
        if not linked.isEmpty():
            raise ValueError("a link cannot point at a link")
        return self._write({key: target}, new=True, old=True, flags="l")

    def followed(self) -> Collection:
        """Live records with links replaced by their targets' values; dangling ones are null."""
        return Collection(follow_links(live(self.log)).where(F.col("_group") == self.group).drop("_op"), self.as_of)

    def in_group(self, name: str) -> Store:
        """The store of a group, over the same log (call :meth:`absorb` to keep its writes)."""
        path = f"{self.group}:::{name}" if self.group else name
        if not all(part.isidentifier() or part.replace("_", "a").isalnum() for part in path.split(":::")):
            raise ValueError(f"not a group name: {name!r}")
        return Store(self.spark, self.log, path, self.as_of, self.check, self._every)

    def absorb(self, group: Store) -> None:
        self.log, self._next = group.log, group._next

    def del_group(self, name: str) -> int:
        inner = self.in_group(name)
        n = inner.clear("yes")
        self.absorb(inner)
        return n

    # ---- history ----------------------------------------------------------------------------

    def revert(self, sel: Any = None, version: int | None = None) -> int:
        """Undo the last write of each selected key, or go back to ``version``."""
        own = self.log.where(F.col("_group") == self.group)
        back = nth_latest(own, 2) if version is None else latest(own, version)
        if sel is not None:
            keys = [sel] if isinstance(sel, str) else list(sel)
            back = back.where(F.col("_id").isin(*map(str, keys)))
        return self._append(back)

    unmodify = unremove = revert

    def history(self, key: str) -> DataFrame:
        """All versions of a key, newest first."""
        return self.log.where((F.col("_group") == self.group) & (F.col("_id") == key)).orderBy(F.col("_ver").desc())

    @property
    def keys(self) -> KeyView:
        return KeyView(self)

    def check_version(self, low: int, high: int) -> DataFrame:
        """Versions in a range of the write counter, history included."""
        return self.log.where((F.col("_ver") >= low) & (F.col("_ver") < high))

    def changes(self, since: int) -> DataFrame:
        """The newest version of every key written since a version, tombstones included."""
        return latest(self.log.where(F.col("_ver") >= since))

    def purge_expired(self) -> int:
        """Drop records past their time to live."""
        gone = self.records().where(expired(F.col("_ttl"), F.col("_mdate"), None, self.as_of or dt.datetime.now()))
        return self._remove(gone.select("_id"))

    def recycle(self) -> None:
        """Forget history: keep only the live versions."""
        self.log = cut(live(self.log))

    def check_error(self) -> DataFrame:
        """Integrity report: versions that occur twice, and live values that are not JSON."""
        twice = self.log.groupBy("_ver").count().where("count > 1").select(F.lit("version").alias("kind"), F.col("_ver").cast("string").alias("what"))
        bad = live(self.log).where(F.try_parse_json("_json").isNull()).select(F.lit("value").alias("kind"), F.col("_id").alias("what"))
        return twice.union(bad)

    def save(self, path: str, compression: str = "zstd") -> None:
        """Snapshot of the whole log."""
        self.log.write.mode("overwrite").option("compression", compression).parquet(path)

    def restore(self, path: str) -> Store:
        """Put a snapshot's log in the place of this one."""
        self.log, self._next = cut(self.spark.read.schema(LOG).parquet(path)), None
        return self

    def clone_to(self, path: str, history: bool = False, with_hidden: bool = True, compression: str = "zstd") -> Store:
        """An independent copy at ``path``: the live records of all groups, or the whole log."""
        log = self.log if history else live(self.log)
        if not with_hidden:
            log = log.where(F.col("_flags").bitwiseAND(mask("h")) == 0)
        log.write.mode("overwrite").option("compression", compression).parquet(path)
        return Store.load(self.spark, path, group=self.group, as_of=self.as_of, check=self.check)

    def upgrade(self, backup: str) -> Store:
        """Compact the log to its live versions, after a snapshot to ``backup``."""
        self.save(backup)
        self.recycle()
        return self

    @classmethod
    def load(cls, spark: SparkSession, path: str, **kw: Any) -> Store:
        return cls(spark, spark.read.schema(LOG).parquet(path), **kw)

    # ---- operators -----------------------------------------------------------------------------

    def __iadd__(self, data: Any) -> Store:
        self.update(data)
        return self

    def __ior__(self, data: Any) -> Store:
        self.insert(data)
        return self

    def __iand__(self, data: Any) -> Store:
        self.replace(data)
        return self

    def __isub__(self, keys: Any) -> Store:
        self.remove(keys.view() if isinstance(keys, Store) else [keys] if isinstance(keys, str) else keys)
        return self

    def __ixor__(self, keys: Any) -> Store:
        self.revert([keys] if isinstance(keys, str) else keys)
        return self


class KeyView:
    """Keys and metadata of a store: selects like the store, and sets dates and flags."""

    META = ("_id", "_ver", "_row", "_cdate", "_mdate", "_ttl", "_flags")

    def __init__(self, store: Store):
        self._store = store

    def __getitem__(self, sel: Any) -> DataFrame:
        return self._store._selected(sel).select(*self.META)

    def find(self, *args: Any, **kw: Any) -> DataFrame:
        return self._store.view().find(*args, **kw).df.select(*self.META)

    def __setitem__(self, sel: Any, day: dt.date | tuple[dt.date, dt.date]) -> None:
        """A date sets the modified date, a datetime the created one, a pair (modified, created) both."""
        mdate, cdate = day if isinstance(day, tuple) else (None, day) if isinstance(day, dt.datetime) else (day, None)
        plain = lambda x: x.date() if isinstance(x, dt.datetime) else x
        self._store.set_date(sel, plain(cdate), plain(mdate))

    def set_flags(self, sel: Any, letters: str) -> int:
        return self._store.set_flags(sel, letters)

    def get_flags(self, sel: Any = slice(None)) -> DataFrame:
        return self._store.get_flags(sel)

    def __and__(self, other: Any) -> DataFrame:
        return self._store.view() & other

    def __or__(self, other: Any) -> DataFrame:
        return self._store.view() | other

    def __sub__(self, other: Any) -> DataFrame:
        return self._store.view() - other

    def __xor__(self, other: Any) -> DataFrame:
        return self._store.view() ^ other


def follow_links(rows: DataFrame) -> DataFrame:
    """Replace the value of link rows by their target's: one join on (group, key)."""
    link = F.col("_flags").bitwiseAND(mask("l")) != 0
    target = F.regexp_replace("_json", '^"|"$', "")
    path = F.split(target, ":::")
    named = rows.withColumn("__l", link).withColumn("__g", F.when(link, F.when(F.size(path) > 1, F.array_join(F.slice(path, 1, F.size(path) - 1), ":::")).otherwise(F.col("_group"))))
    named = named.withColumn("__k", F.when(link, F.element_at(path, -1)))
    values = rows.select(F.col("_group").alias("__g"), F.col("_id").alias("__k"), F.col("_json").alias("__v"))
    out = named.join(values, ["__g", "__k"], "left")
    return out.select(*[F.when(F.col("__l"), F.col("__v")).otherwise(F.col("_json")).alias("_json") if c == "_json" else F.col(c) for c in rows.columns])


def log_from_frame(df: DataFrame, key: Column, version: Column, value: Column, day: Column, op: Column | None = None) -> DataFrame:
    """A version log over a table of changes."""
    return df.select(
        F.lit("").alias("_group"), key.cast("string").alias("_id"), version.cast("long").alias("_ver"), (op if op is not None else F.lit(PUT)).alias("_op"), version.cast("long").alias("_row"),
        F.to_date(day).alias("_cdate"), F.to_date(day).alias("_mdate"), F.lit(0).alias("_ttl"), F.lit(0).alias("_flags"), value.cast("string").alias("_json"),
    )

