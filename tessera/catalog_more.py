"""Registered queries of single writes, key views, paths, importers, streams and graph walks."""

from __future__ import annotations

import contextlib
import io
import json
import sqlite3
import tempfile
import uuid
import zlib
from typing import Any

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tessera.catalog import _LOG, _TG, _UG, _log, _one, add, customers, dt, event_docs, frame, mask, orders, parts, tree_graph, user_graph
from tessera.operators.collection import Collection
from tessera.operators.graph import CycleError, Graph
from tessera.operators.history import Store
from tessera.plans.query import Query
from tessera.plans.storage import ensure_checkpoint_dir

Q = Query()
DAY = dt.date(2024, 1, 1)


def _shared(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that driver and executors share."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _nation_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("_id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))


def _nations(spark: SparkSession, sf_dir: str, **kw: Any) -> Store:
    """All nations as documents."""
    s = Store(spark, as_of=DAY, **kw)
    s.update(_nation_rows(spark, sf_dir))
    return s


def _named(df: DataFrame) -> DataFrame:
    return df.select("_id", F.get_json_object("_json", "$.name").alias("name"), F.get_json_object("_json", "$.region").cast("long").alias("region"))


_N = "SELECT n_nationkey::VARCHAR AS _id, n_name AS name, n_regionkey::BIGINT AS region FROM nation"


# ---- single writes -------------------------------------------------------------------------------
@add("dml_points", f"SELECT _id, CASE _id WHEN '3' THEN 'three' WHEN '4' THEN 'four' ELSE name END AS name, CASE WHEN _id IN ('3', '4') THEN 9 ELSE region END AS region FROM ({_N}) UNION ALL SELECT 'new', 'made', 0")
def dml_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _nations(spark, sf_dir)
    s.set("3", {"name": "three", "region": 9})
    s.set_n({"4": {"name": "four", "region": 9}})
    s.setdefault("1", {"name": "not written", "region": 9})
    s.setdefault("new", {"name": "made", "region": 0})
    return _named(s.records())


@add("dml_assign", f"SELECT _id, CASE region WHEN 1 THEN 'one' WHEN 2 THEN _id || name ELSE name END AS name, CASE region WHEN 1 THEN 7 ELSE region END AS region FROM ({_N})")
def dml_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _nations(spark, sf_dir)
    s[Q.region == 1] = {"name": "one", "region": 7}
    s.assign(Q.region == 2, lambda k, v: {**v, "name": k + v["name"]})
    return _named(s.records())


@add("dml_add", f"SELECT _id, upper(name) || '!' AS name, region FROM ({_N}) WHERE _id = '0' UNION ALL SELECT '2', 'filled', 5 UNION ALL SELECT 'new', 'fresh', 0")
def dml_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records that ``add`` changed: a call on an old value, a default, and a call without one."""
    s = _nations(spark, sf_dir)
    same = s.view().get("1")
    changed = {"0": lambda k, old: {**old, "name": old["name"].upper() + "!"}, "1": same, "2": None, "new": lambda k, old: {"name": "fresh" if old is None else "old", "region": 0}}
    return _named(s.add(changed, default={"name": "filled", "region": 5}).df)


@add(
    "dml_inplace",
    f"SELECT _id, CASE WHEN _id IN ('0', '1') THEN 'a' WHEN _id IN ('2', '3') THEN 'c' ELSE name END AS name, CASE WHEN _id IN ('0', '1', '2', '3') THEN 1 ELSE region END AS region FROM ({_N}) WHERE _id <> '5' UNION ALL SELECT 'x', 'a', 1 UNION ALL SELECT 'y', 'b', 1",
)
def dml_inplace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``+=`` upserts, ``|=`` inserts, ``&=`` replaces, ``-=`` deletes, ``^=`` undoes."""
    s = _nations(spark, sf_dir)
    doc = lambda n: {"name": n, "region": 1}
    s += {k: doc("a") for k in ("0", "1", "x")}
    s |= {k: doc("b") for k in ("0", "y")}
    s &= {k: doc("c") for k in ("2", "3", "z")}
    s -= ["5", "6"]
    s ^= ["6"]
    return _named(s.records())


@add("dml_reinit", "SELECT s_suppkey::VARCHAR AS _id, s_name AS name, s_nationkey::BIGINT AS region FROM supplier")
def dml_reinit(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _nations(spark, sf_dir)
    s.reinit(frame(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("_id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("region")))
    return _named(s.records())


@add("dml_callable_patch", f"SELECT _id, CASE region WHEN 3 THEN lower(name) ELSE name END AS name, region FROM ({_N}) WHERE NOT (region = 3 AND _id::INT % 2 = 0)")
def dml_callable_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _nations(spark, sf_dir)
    s.update_if(Q.region == 3, lambda k, v: {"name": v["name"].lower()} if int(k) % 2 else None)
    return _named(s.records())


@add("dml_check_hook", f"SELECT * FROM ({_N}) WHERE region <> 2")
def dml_check_hook(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named(_nations(spark, sf_dir, check=lambda k, v: v["region"] != 2).records())


@add("dml_append_only", f"SELECT _id, CASE WHEN _id::INT % 2 = 0 THEN name || '+' ELSE name END AS name FROM ({_N})")
def dml_append_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Append-only texts: those that grow are written, those that change are not."""
    names = _nation_rows(spark, sf_dir)
    s = Store(spark, as_of=DAY)
    s.update(names.select("_id", F.to_json(F.struct(F.col("name").alias("v"))).substr(F.lit(6), F.length("name") + 2).alias("_json")), flags="a")
    changed = F.when(F.col("_id").cast("int") % 2 == 0, F.concat("name", F.lit("+"))).otherwise(F.concat(F.lit("+"), F.col("name")))
    s.update(names.select("_id", F.concat(F.lit('"'), changed, F.lit('"')).alias("_json")))
    return s.records().select("_id", F.get_json_object("_json", "$").alias("name"))


@add("dml_restore", f"SELECT _id, name, region, true AS restored FROM ({_N}) UNION ALL SELECT _id, name, region, false FROM ({_N}) WHERE region = 1")
def dml_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snapshot put back after deletes, and an independent copy made before."""
    s, path, copy = _nations(spark, sf_dir), _shared(spark, "snapshot"), _shared(spark, "copy")
    s.save(path)
    s.remove(Q.region != 1)
    cloned = s.clone_to(copy)
    s.restore(path)
    return _named(s.records()).withColumn("restored", F.lit(True)).union(_named(cloned.records()).withColumn("restored", F.lit(False)))


@add("hist_recycle", f"SELECT count(*) AS versions, 0::BIGINT AS errors FROM ({_N}) WHERE region <> 4")
def hist_recycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _nations(spark, sf_dir)
    s.remove(Q.region == 4)
    s.recycle()
    return _one(spark, versions=s.log.count(), errors=s.check_error().count())


@add("slice_version_negative", f"SELECT id AS _id, ver FROM ({_LOG}) WHERE ver >= (SELECT max(event_id) + 1 - 50 FROM events)")
def slice_version_negative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Collection(_log(spark, sf_dir))[-50.0:].df.select("_id", F.col("_ver").alias("ver"))


# ---- keys, flags and dates --------------------------------------------------------------------------
@add("flags_set", f"SELECT _id, CASE WHEN _id = '1' THEN {mask('r')} WHEN region = 1 THEN {mask('rh')} ELSE 0 END AS flags FROM ({_N})")
def flags_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _nations(spark, sf_dir)
    s.set_flags(Q.region == 1, "+rh")
    s.set_flags("1", "-h")
    return s.get_flags().select("_id", F.col("_flags").alias("flags"))


@add("dml_set_date", f"SELECT _id, CASE region WHEN 0 THEN '2020-02-03' ELSE '2024-01-01' END AS modified, CASE region WHEN 0 THEN '2019-01-01' ELSE '2024-01-01' END AS created, CASE region WHEN 0 THEN 2880 ELSE 0 END AS ttl FROM ({_N})")
def dml_set_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _nations(spark, sf_dir)
    s.set_date(Q.region == 0, cdate=dt.date(2019, 1, 1), mdate=dt.date(2020, 2, 3), ttl=2)
    return s.records().select("_id", F.col("_mdate").cast("string").alias("modified"), F.col("_cdate").cast("string").alias("created"), F.col("_ttl").alias("ttl"))


@add("keys_view", f"SELECT _id, CASE WHEN _id = '7' THEN '2018-01-01' WHEN region = 1 THEN '2021-05-06' ELSE '2024-01-01' END AS modified, CASE region WHEN 1 THEN '2020-01-02' ELSE '2024-01-01' END AS created FROM ({_N}) WHERE region <> 2")
def keys_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates set through the key view, and keys read through it by a rule."""
    s = _nations(spark, sf_dir)
    s.keys[Q.region == 1] = (dt.date(2021, 5, 6), dt.date(2020, 1, 2))
    s.keys["7"] = dt.date(2018, 1, 1)
    return s.keys[Q.region != 2].select("_id", F.col("_mdate").cast("string").alias("modified"), F.col("_cdate").cast("string").alias("created"))


_R = "SELECT s_suppkey::VARCHAR AS _id FROM supplier"


@add("set_reflected", f"SELECT 'and' AS op, _id FROM (SELECT '1' AS _id UNION ALL SELECT '2') UNION ALL SELECT 'or', _id FROM (SELECT c_custkey::VARCHAR AS _id FROM customer UNION SELECT 'x') UNION ALL SELECT 'sub', 'x' UNION ALL SELECT 'xor', _id FROM (SELECT c_custkey::VARCHAR AS _id FROM customer WHERE c_custkey NOT IN (1, 2) UNION SELECT 'x')")
def set_reflected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list on the left of ``& | - ^``."""
    c, keys = customers(spark, sf_dir), ["1", "2", "x"]
    out = {"and": keys & c, "or": keys | c, "sub": keys - c, "xor": keys ^ c}
    frames = [df.select(F.lit(op).alias("op"), "_id") for op, df in out.items()]
    return frames[0].union(frames[1]).union(frames[2]).union(frames[3])


@add("select_row_version", f"SELECT 'row' AS kind, o_orderkey::VARCHAR AS _id FROM (SELECT * FROM orders ORDER BY o_orderkey LIMIT 1 OFFSET 5) UNION ALL SELECT 'last', max(o_orderkey)::VARCHAR FROM orders UNION ALL SELECT 'version', id FROM ({_LOG}) WHERE ver = 100")
def select_row_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An integer selects a row, a float a version."""
    o = orders(spark, sf_dir)
    found = {"row": o[5], "last": o[-1], "version": Collection(_log(spark, sf_dir))[100.0]}
    frames = [c.df.select(F.lit(kind).alias("kind"), "_id") for kind, c in found.items()]
    return frames[0].union(frames[1]).union(frames[2])


@add("iter_values", "SELECT c_custkey, c_acctbal, (SELECT count(*) FROM customer) AS n FROM customer")
def iter_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = customers(spark, sf_dir)
    return c.values().select("value.c_custkey", "value.c_acctbal").withColumn("n", F.lit(c.count()))


@add("show_rows", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderkey LIMIT 10")
def show_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    with contextlib.redirect_stdout(io.StringIO()):
        return orders(spark, sf_dir).show(vals={"o_orderstatus": "P"}, limit=10).df.select("o_orderkey")


@add("find_stats", "SELECT count(*) AS records, count(*) FILTER (WHERE NOT regexp_matches(o_orderkey::VARCHAR, '1$')) AS key_filter, count(*) FILTER (WHERE regexp_matches(o_orderkey::VARCHAR, '1$') AND o_orderstatus <> 'F') AS value_filter, count(*) FILTER (WHERE regexp_matches(o_orderkey::VARCHAR, '1$') AND o_orderstatus = 'F') AS matched FROM orders")
def find_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each filter of a find took, observed in the find's own pass."""
    seen = Observation(f"find-{uuid.uuid4().hex}")
    orders(spark, sf_dir).find("1$", {"o_orderstatus": "F"}, stats=seen).df.write.format("noop").mode("overwrite").save()
    return _one(spark, **{k: seen.get[k] for k in ("records", "key_filter", "value_filter", "matched")})


@add("group_limit", "SELECT c_mktsegment AS grp, c_custkey::VARCHAR AS _id FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS n FROM customer WHERE c_acctbal > 0 AND c_mktsegment IN ('BUILDING', 'MACHINERY')) WHERE n BETWEEN 3 AND 7")
def group_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``limit`` and ``skip`` cut each group by itself."""
    c = customers(spark, sf_dir)
    found = Collection(c.df.withColumn("_group", F.col("c_mktsegment"))).find("^(BUILDING|MACHINERY)$:::", Q.c_acctbal > 0, limit=5, skip=2)
    return found.df.select(F.col("_group").alias("grp"), "_id")


# ---- paths -------------------------------------------------------------------------------------------
def _order_docs(spark: SparkSession, sf_dir: str) -> Collection:
    """Orders as nested documents; ``a.b`` is a field's own name beside ``a``."""
    o = frame(spark, sf_dir, "orders")
    doc = F.struct(
        F.struct(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("*state")).alias("a"),
        F.col("o_custkey").alias("a.b"),
        F.array(F.col("o_custkey") % 10, F.col("o_orderkey") % 10).alias("items"),
        F.array(*[F.col("o_orderkey") % 7 + k for k in range(12)]).alias("many"),
    )
    return Collection(o.select(F.col("o_orderkey").cast("string").alias("_id"), F.col("o_orderkey").alias("_row"), F.to_json(doc).alias("_json")))


def path_query(name: str, where: str, rule: dict) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _order_docs(spark, sf_dir).find(vals=rule).df.select(F.col("_id").cast("long").alias("o_orderkey"))

    add(name, f"SELECT o_orderkey FROM orders WHERE {where}")(run)


path_query("path_slash", "o_orderstatus = 'F'", {"a/status": "F"})
path_query("path_bar", "o_orderpriority LIKE '1%'", {"a|priority|$sw": "1"})
path_query("path_backslash", "o_orderstatus = 'P'", {"a\\status": "P"})
path_query("path_literal_key", "o_custkey < 50", {"a.b": {"$lt": 50}})
path_query("path_glob_key", "o_orderstatus = 'O'", {"a.st*": "O"})
path_query("path_glob_char", "o_orderpriority LIKE '2%'", {"a.prior???": {"$sw": "2"}})
path_query("path_list_each", "o_custkey % 10 = 3 OR o_orderkey % 10 = 3", {"items.*": 3})
path_query("path_list_one_digit", "o_orderkey % 7 <= 4", {"many.?": 4})
path_query("path_list_two_digits", "o_orderkey % 7 + 10 = 12 OR o_orderkey % 7 + 11 = 12", {"many.??": 12})


# ---- sorting and grouping ---------------------------------------------------------------------------
@add("sort_mixed_as_text", "SELECT c_custkey, row_number() OVER (ORDER BY CASE WHEN c_custkey % 2 = 0 THEN c_custkey::VARCHAR ELSE c_mktsegment END, c_custkey) - 1 AS pos FROM customer QUALIFY pos < 200")
def sort_mixed_as_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field that is a number in some documents and a text in others sorts as text."""
    c = frame(spark, sf_dir, "customer")
    mixed = F.when(F.col("c_custkey") % 2 == 0, F.to_json(F.struct(F.col("c_custkey").alias("k")))).otherwise(F.to_json(F.struct(F.col("c_mktsegment").alias("k"))))
    docs = Collection(c.select(F.col("c_custkey").cast("string").alias("_id"), F.col("c_custkey").alias("_row"), mixed.alias("_json")))
    return docs.top_k("k", 200).df.select(F.col("_id").cast("long").alias("c_custkey"), F.monotonically_increasing_id().alias("pos"))


@add("grp_bare_field", "SELECT n_regionkey AS _id, string_agg(n_name, ',' ORDER BY n_nationkey) AS names FROM nation GROUP BY 1")
def grp_bare_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bare field collects every other one."""
    c = Collection.from_frame(frame(spark, sf_dir, "nation"), "n_nationkey")
    return c.find(group_by="n_regionkey").df.select("_id", F.array_join("n_name", ",").alias("names"))


@add("grp_text_form", "SELECT c_mktsegment AS _id, round(avg(c_acctbal), 4) AS bal FROM customer GROUP BY 1")
def grp_text_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = customers(spark, sf_dir)
    out = Collection(c.df.select("_id", "_row", "c_mktsegment", "c_acctbal")).find(group_by="c_mktsegment.$avg").df
    return out.select("_id", F.round("c_acctbal", 4).alias("bal"))


# ---- sources and sinks --------------------------------------------------------------------------------
@add("io_records", f"SELECT * FROM ({_N}) WHERE region > 2")
def io_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records given as Python values (a small table's)."""
    records = {r._id: {"name": r.name, "region": r.region} for r in _nation_rows(spark, sf_dir).collect()}
    return _named(Collection.from_records(spark, records).find(vals=Q.region > 2).df)


@add("io_sqlite", "SELECT 'nation' AS grp, n_nationkey::VARCHAR AS _id, n_name AS value FROM nation UNION ALL SELECT 'log', (row_number() OVER (ORDER BY r_regionkey) - 1)::VARCHAR, r_name FROM region")
def io_sqlite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table with a primary key and one without; the file is the driver's own."""
    from tessera.sources.readers import from_sqlite

    nation = [tuple(r) for r in frame(spark, sf_dir, "nation").select("n_nationkey", "n_name").collect()]
    region = [(r.r_name,) for r in frame(spark, sf_dir, "region").orderBy("r_regionkey").collect()]
    with tempfile.TemporaryDirectory() as folder:
        with contextlib.closing(sqlite3.connect(f"{folder}/a.db")) as db, db:
            db.execute("CREATE TABLE nation (k INTEGER PRIMARY KEY, value TEXT)")
            db.execute("CREATE TABLE log (value TEXT)")
            db.executemany("INSERT INTO nation VALUES (?, ?)", nation)
            db.executemany("INSERT INTO log VALUES (?)", region)
        found = from_sqlite(spark, f"{folder}/a.db")
    out = [df.select(F.col("_group").alias("grp"), "_id", "value") for df in found.values()]
    return out[0].union(out[1])


def _settings(spark: SparkSession, sf_dir: str, write: Any, read: Any) -> DataFrame:
    names = {r.r_name: r.r_regionkey for r in frame(spark, sf_dir, "region").collect()}
    with tempfile.NamedTemporaryFile("w", suffix=".txt", encoding="utf-8") as f:
        f.write(write(names))
        f.flush()
        return read(spark, f.name).select("_id", F.get_json_object("_json", "$").alias("value"))


@add("io_ini", "SELECT 'Regions/' || r_name AS _id, r_regionkey::VARCHAR AS value FROM region")
def io_ini(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.sources.readers import from_ini

    return _settings(spark, sf_dir, lambda names: "[Regions]\n" + "".join(f"{k} = {v}\n" for k, v in names.items()), from_ini)


@add("io_toml", "SELECT '/title' AS _id, 'regions' AS value UNION ALL SELECT 'keys/' || r_name, r_regionkey::VARCHAR FROM region")
def io_toml(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.sources.readers import from_toml

    return _settings(spark, sf_dir, lambda names: 'title = "regions"\n[keys]\n' + "".join(f'"{k}" = {v}\n' for k, v in names.items()), from_toml)


@add("io_codec", "SELECT p_partkey::VARCHAR AS _id, p_name, true AS coded FROM part")
def io_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's codec, written as a snapshot and read back."""
    from tessera.sources.writers import backup, decoded, encoded

    path = _shared(spark, "coded")
    p = parts(spark, sf_dir).df.select("_id", encoded("p_name", lambda v: zlib.compress(v.encode())).alias("raw"))
    backup(p, path, "zs")
    back = spark.read.parquet(path)
    return back.select("_id", decoded("raw", lambda b: zlib.decompress(b).decode()).alias("p_name"), (F.hex("raw").startswith("789C")).alias("coded"))


@add("io_dumps", "SELECT 'bz,gz,no,xz,z1' AS codecs, count(*) AS n FROM nation")
def io_dumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codecs in which all nations come back as they were."""
    from tessera.sources.writers import dumps, loads

    values = {r._id: r.name for r in _nation_rows(spark, sf_dir).collect()}
    same = [c for c in ("bz", "gz", "no", "xz", "z1") if loads(dumps(values, c), c) == values and json.loads(dumps(values)) == values]
    return _one(spark, codecs=",".join(same), n=len(values))


# ---- streams (an extension) ----------------------------------------------------------------------------
@add("stream_log", f"SELECT id AS _id, value FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ver DESC) AS n FROM ({_LOG})) WHERE n = 1 AND NOT gone")
def stream_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events appended to a version log as a stream; the newest version of each user."""
    from tessera.operators.history import live
    from tessera.streaming.ingest import append_stream, read_log

    e = frame(spark, sf_dir, "events")
    stream = spark.readStream.schema(e.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    rows = stream.select(F.col("user_id").cast("string").alias("_id"), F.when(F.col("event_type") != "error", F.col("value").cast("string")).alias("_json"))
    log = _shared(spark, "stream-log")
    append_stream(rows, log, _shared(spark, "stream-state")).awaitTermination()
    return live(read_log(spark, log)).select("_id", F.col("_json").cast("double").alias("value"))


@add("stream_windows", "SELECT date_trunc('hour', ts)::VARCHAR AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly counts of a stream, each batch's whole state written."""
    from tessera.streaming.ingest import windowed_counts

    e = frame(spark, sf_dir, "events")
    stream = spark.readStream.schema(e.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    out = _shared(spark, "stream-counts")
    writer = windowed_counts(stream, "ts", "event_type").writeStream.outputMode("complete").option("checkpointLocation", _shared(spark, "stream-state"))
    writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(out)).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n")


# ---- graphs ---------------------------------------------------------------------------------------------
@add("g_edit", f"{_UG} SELECT src, dst, weight, NULL::VARCHAR AS relation FROM e WHERE src = '8' UNION ALL SELECT 'new', '8', 1.5, NULL UNION ALL SELECT 'new', '16', NULL, 'temporary_access' UNION ALL SELECT 'lone', 'new', 2.5, NULL")
def g_edit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes and edges added one by one and in bulk, and an edge that is dated to its end."""
    g = user_graph(spark, sf_dir).add_node("new", age=3).add_edge("new", "8", weight=1.5)
    more = spark.createDataFrame([("lone", "new", 2.5)], "src string, dst string, weight double")
    g = g.add_edges(more).add_temporal_edges(spark.createDataFrame([("new", "16")], "src string, dst string"), F.lit("2030-01-01"))
    return g.edges.where("src in ('8', 'new', 'lone')").select("src", "dst", "weight", "relation")


@add("g_boost", f"{_UG} SELECT src, dst, CASE WHEN src::INT % 2 = 0 THEN round(weight + 0.5, 2) ELSE weight END AS weight FROM e")
def g_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = user_graph(spark, sf_dir)
    g = Graph(g.nodes, g.edges.withColumn("relation", F.when(F.col("src").cast("int") % 2 == 0, "even").otherwise("odd")))
    return g.boost_edge_weights("even", 0.5).edges.select("src", "dst", F.round("weight", 2).alias("weight"))


@add("g_iterate", f"{_TG}, a AS (SELECT src AS id, '>' || dst AS x FROM e UNION ALL SELECT dst, '<' || src FROM e) SELECT id, string_agg(x, ',' ORDER BY x) AS entries FROM a GROUP BY 1")
def g_iterate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree_graph(spark, sf_dir).adjacency().select("id", F.array_join("entries", ",").alias("entries"))


@add("g_export", f"{_UG} SELECT src, dst, weight FROM e")
def g_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _shared(spark, "graph")
    user_graph(spark, sf_dir).export_graph(path)
    return Graph.import_graph(spark, path).edges.select("src", "dst", "weight")


@add("g_dfs", f"{_TG}, d AS (SELECT 'r1' AS id, ['r1'] AS path UNION ALL SELECT dst, list_append(path, dst) FROM d JOIN e ON src = id) SELECT id, row_number() OVER (ORDER BY path) - 1 AS pos FROM d")
def g_dfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = tree_graph(spark, sf_dir).dfs_traverse("r1")
    return spark.createDataFrame([(n, k) for k, n in enumerate(order)], "id string, pos long")


@add("g_find_cycle", "SELECT true AS closed, true AS all_edges, true AS none_in_tree")
def g_find_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cycle's steps lead back to its start along edges; a tree has none."""
    g = user_graph(spark, sf_dir)
    steps = g.find_cycle()
    closed = all(a[2] == b[0] for a, b in zip(steps, steps[1:] + steps[:1], strict=True))
    known = g.edges.join(spark.createDataFrame([(u, v) for u, _, v in steps], "src string, dst string"), ["src", "dst"], "left_semi").count()
    try:
        tree_graph(spark, sf_dir).find_cycle()
        none = False
    except CycleError:
        none = True
    return _one(spark, closed=closed, all_edges=known == len(steps), none_in_tree=none)


_HEAVY = "h AS (SELECT '8' AS id, 0 AS dist UNION SELECT dst, dist + 1 FROM h JOIN e ON src = id WHERE dist < 8 AND weight > 1)"


@add("g_edge_filter", f"{_UG}, {_HEAVY} SELECT id, min(dist) AS dist, true AS as_column FROM h GROUP BY 1 UNION ALL SELECT id, min(dist), false FROM h GROUP BY 1")
def g_edge_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only edges that pass: as a column, and as a callable over their properties."""
    g = user_graph(spark, sf_dir)
    a = g.distances("8", "out", max_hops=8, edge_filter=F.col("weight") > 1).select("id", "dist", F.lit(True).alias("as_column"))
    return a.union(g.distances("8", "out", max_hops=8, edge_filter=lambda p: p["weight"] > 1).select("id", "dist", F.lit(False).alias("as_column")))


@add(
    "g_bfs_path",
    f"{_UG}, d AS (SELECT '8' AS id, 0 AS dist UNION SELECT dst, dist + 1 FROM d JOIN e ON src = id WHERE dist < 8), m AS (SELECT id, min(dist) AS dist FROM d GROUP BY 1), b AS (SELECT id, dist AS pos FROM m WHERE id = '140' UNION ALL SELECT min(src), b.pos - 1 FROM b JOIN e ON dst = b.id JOIN m ON m.id = src AND m.dist = b.pos - 1 GROUP BY b.pos) SELECT id, pos::BIGINT AS pos FROM b",
)
def g_bfs_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = user_graph(spark, sf_dir).bfs_shortest_path("8", "140")
    return spark.createDataFrame([(n, k) for k, n in enumerate(path)], "id string, pos long")


@add(
    "g_dijkstra_path",
    f"{_UG}, r AS (SELECT '8' AS id, 0.0::DOUBLE AS d, 0 AS k UNION ALL SELECT id, min(d), k FROM (SELECT dst AS id, r.d + weight AS d, r.k + 1 AS k FROM r JOIN e ON src = r.id WHERE r.k < 30) GROUP BY id, k), m AS (SELECT id, min(d) AS d FROM r GROUP BY 1), b AS (SELECT id, d, 0 AS back FROM m WHERE id = '140' UNION ALL SELECT min(src), arg_min(x.d, src), b.back + 1 FROM b JOIN e ON dst = b.id JOIN m x ON x.id = src WHERE abs(x.d + weight - b.d) < 1e-9 GROUP BY b.back) SELECT id, ((SELECT max(back) FROM b) - back)::BIGINT AS pos, round((SELECT d FROM m WHERE id = '140'), 2) AS dist FROM b",
)
def g_dijkstra_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    dist, path = user_graph(spark, sf_dir).dijkstra_shortest_path("8", "140")
    return spark.createDataFrame([(n, k, round(dist, 2)) for k, n in enumerate(path)], "id string, pos long, dist double")


def market_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Nations and the market segments of their customers, without directions: many equal shortest paths."""
    c = frame(spark, sf_dir, "customer").where("c_acctbal > 8000")
    return Graph.from_edges(c.select(F.concat(F.lit("n"), F.col("c_nationkey")).alias("src"), F.col("c_mktsegment").alias("dst")).distinct(), directed=False)


_MG = """WITH RECURSIVE x AS (SELECT DISTINCT 'n' || c_nationkey AS a, c_mktsegment AS b FROM customer WHERE c_acctbal > 8000),
p AS (SELECT a AS u, b AS v FROM x UNION ALL SELECT b, a FROM x), n AS (SELECT DISTINCT u AS id FROM p),
d AS (SELECT id AS s, id, 0 AS k FROM n UNION SELECT s, v, k + 1 FROM d JOIN p ON u = id WHERE k < 9),
m AS (SELECT s, id, min(k) AS k FROM d GROUP BY 1, 2),
g AS (SELECT id AS s, id AS t, 0 AS k, 1.0::DOUBLE AS c FROM n UNION ALL SELECT g.s, v, g.k + 1, sum(g.c) FROM g JOIN p ON u = g.t JOIN m ON m.s = g.s AND m.id = v AND m.k = g.k + 1 GROUP BY g.s, v, g.k)"""


@add(
    "g_betweenness_paths",
    f"{_MG}, t AS (SELECT a.t AS id, sum(a.c * b.c / w.c) AS x FROM g a JOIN g b ON b.s = a.t JOIN g w ON w.s = a.s AND w.t = b.t AND w.k = a.k + b.k WHERE a.s <> a.t AND b.t <> a.t AND a.s <> b.t GROUP BY 1) SELECT id, round(coalesce(x, 0) / ((SELECT count(*) FROM n) - 1) / ((SELECT count(*) FROM n) - 2), 8) AS betweenness FROM n LEFT JOIN t USING (id)",
)
def g_betweenness_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market_graph(spark, sf_dir).betweenness_centrality().select("id", F.round("betweenness", 8).alias("betweenness"))


@add("g_closeness_paths", f"{_MG} SELECT s AS id, round(CASE WHEN sum(k) > 0 THEN (count(*) - 1) / sum(k) * (count(*) - 1) / ((SELECT count(*) FROM n) - 1) ELSE 0 END, 8) AS closeness FROM m GROUP BY 1")
def g_closeness_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market_graph(spark, sf_dir).closeness_centrality().select("id", F.round("closeness", 8).alias("closeness"))
