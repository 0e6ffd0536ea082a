"""Registered queries of the engine's own operators, each with DuckDB SQL for the same result."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.flags import mask
from tessera.operators.collection import Collection
from tessera.operators.graph import Graph
from tessera.operators.history import Store, follow_links, latest, live, log_from_frame, nth_latest
from tessera.plans.query import Query

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
Q = Query()
AS_OF = dt.date(1998, 8, 1)


def add(name: str, sql: str | None = None):
    """Register a query under a name."""

    def put(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders(spark: SparkSession, sf_dir: str) -> Collection:
    """``o_orderdate`` is the modified date, the created date is ten days before."""
    df = frame(spark, sf_dir, "orders").withColumn("__made", F.date_sub(F.to_date("o_orderdate"), 10))
    c = Collection.from_frame(df, "o_orderkey", cdate="__made", mdate="o_orderdate", as_of=AS_OF)
    return Collection(c.df.drop("__made"), AS_OF)


def customers(spark: SparkSession, sf_dir: str) -> Collection:
    return Collection.from_frame(frame(spark, sf_dir, "customer"), "c_custkey")


def parts(spark: SparkSession, sf_dir: str) -> Collection:
    return Collection.from_frame(frame(spark, sf_dir, "part"), "p_partkey")


def lineitems(spark: SparkSession, sf_dir: str) -> Collection:
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return Collection.from_frame(frame(spark, sf_dir, "lineitem"), keys)


def events(spark: SparkSession, sf_dir: str) -> Collection:
    return Collection.from_frame(frame(spark, sf_dir, "events"), "event_id")


def vectors(spark: SparkSession, sf_dir: str) -> Collection:
    return Collection.from_frame(frame(spark, sf_dir, "embeddings"), "vec_id")


def event_docs(spark: SparkSession, sf_dir: str) -> Collection:
    """``props`` as documents without a schema."""
    e = frame(spark, sf_dir, "events")
    return Collection(e.select(F.col("event_id").cast("string").alias("_id"), F.col("event_id").alias("_row"), F.col("props").alias("_json")))


# Kind of rows: (collection, columns of the result, table).
KINDS: dict[str, tuple[Callable, str, str]] = {
    "o": (orders, "o_orderkey, o_custkey, o_totalprice", "orders"),
    "c": (customers, "c_custkey, c_name, c_acctbal", "customer"),
    "p": (parts, "p_partkey, p_name, p_retailprice", "part"),
    "l": (lineitems, "l_orderkey, l_partkey, l_linenumber, l_extendedprice", "lineitem"),
    "e": (events, "event_id, user_id, value", "events"),
    "v": (vectors, "vec_id, label", "embeddings"),
}


def pred(name: str, kind: str, where: str, rule: Any = None, **find: Any) -> None:
    """A filter query: the rule's matches against a WHERE clause."""
    make, cols, source = KINDS[kind]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return make(spark, sf_dir).find(vals=rule, **find).df.select(*cols.split(", "))

    add(name, f"SELECT {cols} FROM {source} WHERE {where}")(run)


# ---- predicates: comparisons -------------------------------------------------------------------
pred("pred_eq", "o", "o_orderstatus = 'F'", {"o_orderstatus": "F"})
pred("pred_ne", "o", "o_orderstatus <> 'F'", Q.o_orderstatus != "F")
pred("pred_gt", "l", "l_quantity > 45", {"l_quantity.$gt": 45})
pred("pred_gte", "l", "l_quantity >= 48", Q.l_quantity >= 48)
pred("pred_lt", "l", "l_discount < 0.01", {"l_discount": {"$lt": 0.01}})
pred("pred_lte", "c", "c_acctbal <= 0", Q.c_acctbal <= 0)
pred("pred_between", "o", "o_totalprice BETWEEN 100000 AND 120000", Q.o_totalprice.between(100000, 120000))
pred("pred_near", "p", "abs(p_retailprice - 950) <= 5", {"p_retailprice.$near": (950, 5)})
pred("pred_mod", "o", "o_orderkey % 7 = 3", Q.o_orderkey.mod(7, 3))
pred("pred_mod_negative", "c", "c_custkey - (-7) * floor(c_custkey / -7.0) = -2", Q.c_custkey.mod(-7, -2))
# ---- membership and text ------------------------------------------------------------------------
pred("pred_in", "o", "o_orderpriority IN ('1-URGENT', '2-HIGH')", {"o_orderpriority": ["1-URGENT", "2-HIGH"]})
pred("pred_nin", "o", "o_orderpriority NOT IN ('1-URGENT', '2-HIGH')", {"o_orderpriority.$nin": ["1-URGENT", "2-HIGH"]})
pred("pred_anyin", "c", "c_mktsegment IN ('BUILDING')", Q.c_mktsegment.any_in(["BUILDING", "NONE"]))
pred("pred_in_text", "o", "o_orderstatus IN ('F', 'O')", {"o_orderstatus.$in": "FO"})
pred("pred_has", "p", "contains(p_name, 'ring')", Q.p_name.has("ring"))
pred("pred_ihas", "p", "contains(lower(p_name), 'widget')", {"p_name.$ihas": "WIDGET"})
pred("pred_nhas", "p", "NOT contains(p_name, 'ring')", Q.p_name.not_has("ring"))
pred("pred_sw", "p", "p_name LIKE 'red%' OR p_name LIKE 'small%'", {"p_name.$sw": ("red", "small")})
pred("pred_ew", "p", "p_name LIKE '%widget'", Q.p_name.endswith("widget"))
pred("pred_re", "p", "regexp_matches(p_brand, '#1[0-5]$')", {"p_brand": re.compile(r"#1[0-5]$")})
pred("pred_re_flags", "p", "regexp_matches(p_type, '^(promo|small)$', 'i')", {"p_type": re.compile(r"^(?P<kind>promo|small)$", re.I)})
pred("pred_re2", "e", "regexp_matches(regexp_replace(props, '[\",{}\\[\\]]', '', 'g'), 'k: 4[0-9]')", {"props.$re2": r"k: 4[0-9]"})
pred("pred_match", "p", "regexp_full_match(p_brand, 'Brand#[12]')", Q.p_brand.fullmatch(r"Brand#[12]"))
pred("pred_type", "o", "o_orderkey IS NOT NULL", {"o_totalprice.$type": "float", "o_orderkey.$type": "int", "o_orderstatus.$type": "str"})
pred("pred_exists", "o", "true", {"$exists": ["o_orderkey", "o_custkey"]})
pred("pred_exists_not", "o", "true", {"!$exists": "no_such_field"})
# ---- arrays -------------------------------------------------------------------------------------
pred("pred_size", "v", "len(embedding) = 64", {"embedding.$size": 64})
pred("pred_index0", "v", "embedding[1] > 0.1", {"embedding": {"$0": {"$gt": 0.1}}})
pred("pred_index_last", "v", "embedding[len(embedding)] < -0.1", {"embedding.-1.$lt": -0.1})
pred("pred_any", "v", "len(list_filter(embedding, lambda x: x > 0.35)) > 0", {"embedding": {"$any": {"$gt": 0.35}}})
pred("pred_all", "v", "len(list_filter(embedding, lambda x: NOT x < 0.3)) = 0", {"embedding": {"$all": {"$lt": 0.3}}})
pred("pred_none", "v", "len(list_filter(embedding, lambda x: x < -0.35)) = 0", {"embedding": {"$none": {"$lt": -0.35}}})
pred("pred_star", "v", "len(list_filter(embedding, lambda x: x > 0.4)) > 0", {"embedding.*.$gt": 0.4})
# ---- logic --------------------------------------------------------------------------------------
pred("logic_and", "o", "o_orderstatus = 'O' AND o_totalprice > 300000", (Q.o_orderstatus == "O") & (Q.o_totalprice > 300000))
pred("logic_or", "o", "o_orderstatus = 'P' OR o_totalprice > 400000", None, OR=[{"o_orderstatus": "P"}, {"o_totalprice.$gt": 400000}])
pred("logic_not", "o", "NOT o_orderstatus = 'F'", ~(Q.o_orderstatus == "F"))
pred("logic_nor", "o", "NOT (o_orderstatus = 'F' OR o_totalprice < 200000)", None, NOR=[{"o_orderstatus": "F"}, {"o_totalprice.$lt": 200000}])
pred("logic_nand", "o", "NOT (o_orderstatus = 'F' AND o_totalprice < 200000)", None, NAND=[{"o_orderstatus": "F"}, {"o_totalprice.$lt": 200000}])
pred("logic_guarded", "o", "false", {"o_orderstatus.$ne": 5})
pred("logic_inverted_field", "o", "true", {"!o_orderstatus": 5})
pred("logic_complement", "o", "true", {"$not": {"o_orderstatus": 5}})
pred("logic_missing", "o", "false", {"!no_such_field": 5})
pred("logic_missing_not", "o", "true", {"$not": {"no_such_field": 5}})
pred("logic_empty_and", "o", "false", {"$and": []})
pred("logic_empty_rule", "c", "true", {})
pred("logic_nested", "l", "(l_returnflag = 'R' OR l_quantity > 40) AND NOT l_linestatus = 'O'", {"$or": [{"l_returnflag": "R"}, {"l_quantity.$gt": 40}], "!l_linestatus": "O"})
# ---- transforms in predicates -------------------------------------------------------------------
pred("xf_round", "c", "round_even(c_acctbal, 0) % 2 = 0 AND c_acctbal > 9000", {"c_acctbal.$round.$mod": (2, 0), "c_acctbal.$gt": 9000})
pred("xf_abs", "c", "abs(c_acctbal) < 50", {"c_acctbal.$abs.$lt": 50})
pred("xf_floor", "l", "floor(l_discount * 1.0) = 0 AND floor(l_quantity) = 7", {"l_discount.$floor": 0, "l_quantity.$floor": 7})
pred("xf_ceil", "o", "ceil(o_totalprice) % 100 = 0", {"o_totalprice.$ceil.$mod": (100, 0)})
pred("xf_neg", "c", "-c_acctbal > 900", Q.c_acctbal.neg() > 900)
pred("xf_int", "o", "try_cast(o_orderpriority[1] AS BIGINT) = 2", {"o_orderpriority.$first.$int": 2})
pred("xf_float", "o", "try_cast(o_orderpriority[1] AS DOUBLE) >= 4", {"o_orderpriority.$first.$float.$gte": 4.0})
pred("xf_str", "o", "CAST(o_orderkey AS VARCHAR) LIKE '%77'", Q.o_orderkey.str().endswith("77"))
pred("xf_lower", "c", "lower(c_mktsegment) = 'building'", Q.c_mktsegment.lower() == "building")
pred("xf_upper", "p", "upper(p_name) LIKE 'RED%'", Q.p_name.upper().startswith("RED"))
pred("xf_strip", "p", "trim(p_name) = p_name AND length(trim(p_name)) > 11", Q.p_name.strip().len() > 11)
pred("xf_len", "p", "length(p_name) = 10", Q.p_name.len() == 10)
pred("xf_last", "p", "right(p_name, 1) = 't'", Q.p_name.last() == "t")
# ---- dates --------------------------------------------------------------------------------------
pred("date_eq", "o", "o_orderdate::DATE = DATE '1998-08-01'", None, date=dt.date(1998, 8, 1))
pred("date_created", "o", "o_orderdate::DATE - 10 = DATE '1998-07-22'", None, date=dt.datetime(1998, 7, 22))
pred("date_range", "o", "o_orderdate::DATE BETWEEN DATE '1998-07-01' AND DATE '1998-07-15'", {"_date": {"$between": (dt.date(1998, 7, 1), dt.date(1998, 7, 15))}})
pred("date_near", "o", "abs(o_orderdate::DATE - DATE '1998-08-01') <= 2", {"_date.$near": (dt.date(1998, 8, 1), 2)})
pred("date_mod", "o", "(o_orderdate::DATE - DATE '0001-01-01' + 1) % 365 = 4", {"_date.$mod": (365, 4)})
pred("date_text", "o", "contains((o_orderdate::DATE - 10)::DATE || ' ' || o_orderdate::DATE, '1999-02')", None, date="1999-02")
pred("date_number", "o", "o_orderdate::DATE BETWEEN DATE '1998-07-29' AND DATE '1998-08-01'", None, date=-3)
pred("key_rule", "o", "regexp_matches(o_orderkey::VARCHAR, '99$')", {"_id.$re": "99$"})
pred("key_regex", "o", "regexp_matches(o_orderkey::VARCHAR, '^12.4$')", None, keys=r"^12.4$")
pred("key_in", "o", "o_orderkey IN (3, 5, 8, 13)", None, keys=["3", "5", "8", "13"])
pred("pred_func", "p", "p_size % 2 = 0 AND p_retailprice > 1000", {"p_size": lambda v: v % 2 == 0, "p_retailprice.$gt": 1000})
pred("filter_bench", "l", "l_returnflag = 'R' AND l_extendedprice > 50000", {"l_returnflag": "R", "l_extendedprice.$gt": 50000})
pred("docs_len", "p", "length(p_type) = 5", Q.p_type.len() == 5)


def doc_pred(name: str, where: str, rule: Any = None, **find: Any) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return event_docs(spark, sf_dir).find(vals=rule, **find).df.select(F.col("_id").cast("long").alias("event_id"), F.col("_json").alias("props"))

    add(name, f"SELECT event_id, props FROM events WHERE {where}")(run)


_K = "CAST(json_extract(props, '$.k') AS BIGINT)"
doc_pred("pred_path_json", f"{_K} >= 90", {"k.$gte": 90})
doc_pred("pred_json_type", "true", {"k.$type": "int"})
doc_pred("pred_json_guard", "false", {"k": "69"})
doc_pred("pred_json_any", f"{_K} = 42", None, ANY=42)
doc_pred("pred_wildcard", f"{_K} BETWEEN 10 AND 12", {"**.$between": (10, 12)})
doc_pred("pred_json_re", f"{_K} BETWEEN 70 AND 79", None, RE=r'"k":7[0-9]\}')
doc_pred("pred_json_exists", "true", None, EXISTS="k")
doc_pred("pred_json_in", f"{_K} IN (1, 2, 3)", {"k": [1, 2, 3]})


# ---- array transforms ----------------------------------------------------------------------------
def vector_xf(op: str, sql: str, digits: int = 5) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from tessera.functions.transforms import applied

        df = frame(spark, sf_dir, "embeddings").withColumn("e", F.transform("embedding", lambda x: F.round(x.cast("double"), 3)))
        c, t = applied(op, F.col("e"), df.schema["e"].dataType)
        out = F.array_join(F.transform(F.slice(c, 1, 5), lambda x: F.format_string("%.3f", x)), ",") if t.typeName() == "array" else F.round(c, digits)
        return df.select("vec_id", out.alias("out"))

    add(f"xf_{op}", f"WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: round(x::DOUBLE, 3) + 0.0) AS e FROM embeddings) SELECT vec_id, {sql} AS out FROM e")(run)


_TEXT = "array_to_string(list_transform({}, lambda x: printf('%.3f', x)), ',')"
vector_xf("avg", "round(list_avg(e), 9)", 9)  # means of 64 thousandths have 9 decimals: nothing to round
vector_xf("std", "round(list_stddev_pop(e), 5)")
vector_xf("sum", "round(list_sum(e), 5)")
vector_xf("min", "round(list_min(e), 5)")
vector_xf("max", "round(list_max(e), 5)")
vector_xf("mid", "round(e[len(e) // 2 + 1], 5)")
vector_xf("first", "round(e[1], 5)")
vector_xf("sort", _TEXT.format("list_sort(e)[1:5]"))
vector_xf("unique", _TEXT.format("list_distinct_ordered(e)[1:5]").replace("list_distinct_ordered(e)", "list_filter(e, lambda x, i: list_position(e, x) = i)"))
vector_xf("flat", _TEXT.format("e[1:5]"))


# ---- grouping --------------------------------------------------------------------------------------
@add(
    "grp_avg",
    "SELECT l_returnflag AS _id, round(avg(l_quantity), 4) AS q, round(avg(l_extendedprice), 4) AS x FROM lineitem GROUP BY 1",
)
def grp_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lineitems(spark, sf_dir).find(group_by={"l_returnflag": ["l_quantity.$avg", "l_extendedprice.$avg"]}).df
    return out.select("_id", F.round("l_quantity", 4).alias("q"), F.round("l_extendedprice", 4).alias("x"))


@add("grp_composite_sum", "SELECT l_returnflag AS _id0, l_linestatus AS _id1, round(sum(l_quantity), 2) AS q FROM lineitem GROUP BY 1, 2")
def grp_composite_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = lineitems(spark, sf_dir)
    out = Collection(c.df.select("_id", "_row", "l_returnflag", "l_linestatus", "l_quantity")).find(group_by=["l_returnflag", "l_linestatus", "$sum"]).df
    return out.select("_id0", "_id1", F.round("l_quantity", 2).alias("q"))


@add("grp_explicit", "SELECT o_orderpriority AS _id, max(o_totalprice) AS hi, min(o_totalprice) AS lo, count(*) AS n FROM orders GROUP BY 1")
def grp_explicit(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = orders(spark, sf_dir).find(group_by={"o_orderpriority": ["o_totalprice.$max", "o_totalprice.$min", "o_orderkey.$len"]}).df
    return out.select("_id", F.col("o_totalprice").alias("hi"), F.col("`o_totalprice.$min`").alias("lo"), F.col("o_orderkey").alias("n"))


@add("grp_key_transform", "SELECT lower(c_mktsegment) AS _id, round(sum(c_acctbal), 2) AS s FROM customer GROUP BY 1")
def grp_key_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = customers(spark, sf_dir).find(group_by={"c_mktsegment.$lower": ["c_acctbal.$sum"]}).df
    return out.select("_id", F.round("c_acctbal", 2).alias("s"))


@add("grp_std", "SELECT event_type AS _id, round(stddev_pop(value), 6) AS s FROM events GROUP BY 1")
def grp_std(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).find(group_by={"event_type": ["value.$std"]}).df.select("_id", F.round("value", 6).alias("s"))


@add("grp_list", "SELECT c_nationkey AS _id, string_agg(c_custkey::VARCHAR, ',' ORDER BY c_custkey) AS ids FROM customer GROUP BY 1")
def grp_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = customers(spark, sf_dir).find(group_by={"c_nationkey": ["_id"]}).df
    return out.select("_id", F.array_join("_ids", ",").alias("ids"))


@add(
    "grp_unique",
    "SELECT p_type AS _id, string_agg(p_size::VARCHAR, ',' ORDER BY f) AS sizes FROM (SELECT p_type, p_size, min(p_partkey) AS f FROM part GROUP BY 1, 2) GROUP BY 1",
)
def grp_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = parts(spark, sf_dir).find(group_by={"p_type": ["p_size.$unique"]}).df
    return out.select("_id", F.array_join(F.transform("p_size", lambda x: x.cast("string")), ",").alias("sizes"))


@add("grp_first_last", "SELECT event_type AS _id, arg_min(value, event_id) AS first, arg_max(value, event_id) AS last FROM events GROUP BY 1")
def grp_first_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = events(spark, sf_dir).find(group_by={"event_type": ["value.$first", "value.$last"]}).df
    return out.select("_id", F.col("value").alias("first"), F.col("`value.$last`").alias("last"))


@add("grp_date", "SELECT (o_orderdate::DATE)::VARCHAR AS _id, count(*) AS n FROM orders GROUP BY 1")
def grp_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = orders(spark, sf_dir).find(group_by={"_date.$last": ["o_orderkey.$len"]}).df
    return out.select(F.col("_id").cast("string").alias("_id"), F.col("o_orderkey").alias("n"))


@add("grp_filtered", "SELECT o_orderstatus AS _id, round(avg(o_totalprice), 4) AS x FROM orders WHERE o_totalprice >= 100000 GROUP BY 1")
def grp_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = orders(spark, sf_dir).find(vals=Q.o_totalprice >= 100000, group_by={"o_orderstatus": ["o_totalprice.$avg"]}).df
    return out.select("_id", F.round("o_totalprice", 4).alias("x"))


@add("grp_missing_key", "SELECT NULL::VARCHAR AS _id, round(sum(c_acctbal), 2) AS s, 0::BIGINT AS none FROM customer")
def grp_missing_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = customers(spark, sf_dir).find(group_by={"no_such_field": ["c_acctbal.$sum", "nothing.$len"]}).df
    return out.select("_id", F.round("c_acctbal", 2).alias("s"), F.col("nothing").alias("none"))


@add(
    "agg_bench",
    "SELECT l_returnflag AS _id, round(sum(l_quantity), 2) AS qty, round(avg(l_extendedprice), 4) AS price, count(*) AS n FROM lineitem WHERE l_discount BETWEEN 0.02 AND 0.08 AND l_extendedprice > 1000 GROUP BY 1",
)
def agg_bench(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filter, group and sort, the shape of the baseline report."""
    rule = Q.l_discount.between(0.02, 0.08) & (Q.l_extendedprice > 1000)
    out = lineitems(spark, sf_dir).find(vals=rule, group_by={"l_returnflag": ["l_quantity.$sum", "l_extendedprice.$avg", "l_orderkey.$len"]}, sort="_id").df
    return out.select("_id", F.round("l_quantity", 2).alias("qty"), F.round("l_extendedprice", 4).alias("price"), F.col("l_orderkey").alias("n"))


# ---- sorting, limits, slices ---------------------------------------------------------------------
def _ranked(c: Collection, *cols: str) -> DataFrame:
    """The order of a small sorted result as a column, so that an unordered comparison sees it."""
    return c.df.select(*cols, F.monotonically_increasing_id().alias("pos"))


@add(
    "sort_multi",
    "SELECT c_custkey, row_number() OVER (ORDER BY c_mktsegment, c_acctbal, c_custkey) - 1 AS pos FROM customer QUALIFY pos < 500",
)
def sort_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(customers(spark, sf_dir).top_k(["c_mktsegment", "c_acctbal"], 500), "c_custkey")


@add(
    "sort_reverse",
    "SELECT c_custkey, row_number() OVER (ORDER BY c_mktsegment DESC, c_acctbal DESC, c_custkey) - 1 AS pos FROM customer QUALIFY pos < 500",
)
def sort_reverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(customers(spark, sf_dir).top_k(["c_mktsegment", Q.c_acctbal], 500, reverse=True), "c_custkey")


@add(
    "sort_transform",
    "SELECT p_partkey, row_number() OVER (ORDER BY length(p_name), p_partkey) - 1 AS pos FROM part QUALIFY pos < 300",
)
def sort_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(parts(spark, sf_dir).top_k("p_name.$len", 300), "p_partkey")


@add(
    "sort_missing_last",
    "SELECT c_custkey, row_number() OVER (ORDER BY (c_acctbal < 0), CASE WHEN c_acctbal >= 0 THEN c_acctbal END DESC, CASE WHEN c_acctbal < 0 THEN c_custkey::VARCHAR END DESC, c_custkey) - 1 AS pos FROM customer QUALIFY pos >= 0",
)
def sort_missing_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = frame(spark, sf_dir, "customer").withColumn("bal", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")))
    done = Collection.from_frame(df, "c_custkey").sort("bal", reverse=True)
    return _ranked(Collection(done.df.coalesce(1)), "c_custkey")


@add("limit_then_sort", "SELECT o_orderkey FROM (SELECT * FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderkey LIMIT 50)")
def limit_then_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders(spark, sf_dir).find(vals={"o_orderstatus": "O"}, limit=50, sort="o_totalprice").df.select("o_orderkey")


@add("skip_limit", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 40 OFFSET 25")
def skip_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders(spark, sf_dir).find(vals={"o_orderstatus": "F"}, skip=25, limit=40).df.select("o_orderkey")


@add("slice_rows", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 150 OFFSET 100")
def slice_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders(spark, sf_dir)[100:250].df.select("o_orderkey")


@add("slice_step", "SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS r FROM orders) WHERE r >= 10 AND (r - 10) % 7 = 0")
def slice_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders(spark, sf_dir)[10::7].df.select("o_orderkey")


@add("slice_negative", "SELECT o_orderkey FROM orders ORDER BY o_orderkey DESC LIMIT 20")
def slice_negative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders(spark, sf_dir)[-20:].df.select("o_orderkey")


@add("slice_dates", "SELECT o_orderkey FROM orders WHERE o_orderdate::DATE >= DATE '1997-01-01' AND o_orderdate::DATE < DATE '1997-02-01'")
def slice_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders(spark, sf_dir)[dt.date(1997, 1, 1) : dt.date(1997, 2, 1)].df.select("o_orderkey")


@add("slice_key_rule", "SELECT o_orderkey FROM orders WHERE regexp_matches(o_orderkey::VARCHAR, '[05]1$')")
def slice_key_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders(spark, sf_dir)[::r"[05]1$"].df.select("o_orderkey")


# ---- key sets ----------------------------------------------------------------------------------------
def _sets(spark: SparkSession, sf_dir: str) -> tuple[Collection, DataFrame]:
    """Customers, and the customer keys of orders shifted so that some are strangers."""
    other = frame(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select((F.col("o_custkey") + 200).cast("string").alias("k"))
    return customers(spark, sf_dir), other


_C, _S = "SELECT c_custkey::VARCHAR AS _id FROM customer", "SELECT (o_custkey + 200)::VARCHAR AS _id FROM orders WHERE o_orderstatus = 'P'"
for _name, _method, _sql in (
    ("set_and", "intersection", f"{_C} INTERSECT {_S}"),
    ("set_or", "union", f"{_C} UNION {_S}"),
    ("set_sub", "difference", f"{_C} EXCEPT {_S}"),
    ("set_rsub", "non_joint", f"{_S} EXCEPT {_C}"),
    ("set_xor", "symmetric_difference", f"({_C} EXCEPT {_S}) UNION ({_S} EXCEPT {_C})"),
):
    add(_name, _sql)(lambda spark, sf_dir, m=_method: (lambda c, o: getattr(c, m)(o))(*_sets(spark, sf_dir)))


def _one(spark: SparkSession, **values: Any) -> DataFrame:
    return spark.range(1).select(*[(F.lit(v).cast("long") if type(v) is int else F.lit(v)).alias(k) for k, v in values.items()])


@add(
    "set_tests",
    f"SELECT NOT EXISTS ({_S} EXCEPT {_C}) AS superset, NOT EXISTS ({_C} EXCEPT {_S}) AS subset, NOT EXISTS ({_C} INTERSECT {_S}) AS disjoint, true AS has_all, true AS has_any",
)
def set_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = _sets(spark, sf_dir)
    return _one(spark, superset=c.is_superset(o), subset=c.is_subset(o), disjoint=c.is_disjoint(o), has_all=c.has_all(["1", "2"]), has_any=c.has_any(["1", "no"]))


@add("db_eq", "SELECT true AS same, false AS other")
def db_eq(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = customers(spark, sf_dir)
    changed = Collection.from_frame(frame(spark, sf_dir, "customer").withColumn("c_acctbal", F.when(F.col("c_custkey") == 7, 0.0).otherwise(F.col("c_acctbal"))), "c_custkey")
    return _one(spark, same=c.same_as(customers(spark, sf_dir)), other=c.same_as(changed))


# ---- writes and history --------------------------------------------------------------------------------
def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One version per event: the user's last value; an ``error`` deletes the user."""
    e = frame(spark, sf_dir, "events")
    op = F.when(F.col("event_type") == "error", "del").otherwise("put")
    return log_from_frame(e, F.col("user_id"), F.col("event_id"), F.col("value"), F.col("ts"), op)


_LOG = "SELECT user_id::VARCHAR AS id, event_id AS ver, event_type = 'error' AS gone, value, ts FROM events"


def _value() -> Column:
    return F.col("_json").cast("double").alias("value")



@add("hist_live", f"SELECT id AS _id, value FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ver DESC) AS n FROM ({_LOG})) WHERE n = 1 AND NOT gone")
def hist_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live(_log(spark, sf_dir)).select("_id", _value())


@add("hist_as_of", f"SELECT id AS _id, value FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ver DESC) AS n FROM ({_LOG}) WHERE ver < 500) WHERE n = 1 AND NOT gone")
def hist_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live(_log(spark, sf_dir), 500).select("_id", _value())


@add("hist_revert", f"SELECT id AS _id, value FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ver DESC) AS n FROM ({_LOG})) WHERE n = 2 AND NOT gone")
def hist_revert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nth_latest(_log(spark, sf_dir), 2).where("_op = 'put'").select("_id", _value())


@add("hist_changes", f"SELECT id AS _id, CASE WHEN gone THEN 'del' ELSE 'put' END AS op FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ver DESC) AS n FROM ({_LOG}) WHERE ver >= 900) WHERE n = 1")
def hist_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _log(spark, sf_dir)
    return latest(log.where("_ver >= 900")).select("_id", F.col("_op").alias("op"))


@add("slice_version", f"SELECT id AS _id, ver FROM ({_LOG}) WHERE ver >= 100 AND ver < 200")
def slice_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Collection(_log(spark, sf_dir)).versions(100.0, 200.0).df.select("_id", F.col("_ver").alias("ver"))


def _store(spark: SparkSession, sf_dir: str) -> Store:
    """All customers as documents."""
    s = Store(spark, as_of=dt.date(2024, 1, 1))
    s.update(frame(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("_id"), F.col("c_acctbal").alias("bal"), F.col("c_mktsegment").alias("seg")))
    return s


def _incoming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All suppliers under keys of which some are customers'."""
    s = frame(spark, sf_dir, "supplier")
    return s.select((F.col("s_suppkey") * 20).cast("string").alias("_id"), F.col("s_acctbal").alias("bal"), F.col("s_name").alias("seg"))


def _fields(s: Store) -> DataFrame:
    return s.records().select("_id", F.get_json_object("_json", "$.bal").cast("double").alias("bal"), F.get_json_object("_json", "$.seg").alias("seg"))


_OLD = "SELECT c_custkey::VARCHAR AS _id, c_acctbal AS bal, c_mktsegment AS seg FROM customer"
_NEW = "SELECT (s_suppkey * 20)::VARCHAR AS _id, s_acctbal AS bal, s_name AS seg FROM supplier"
_KEPT, _ADDED = f"SELECT * FROM ({_OLD}) WHERE _id NOT IN (SELECT _id FROM ({_NEW}))", f"SELECT * FROM ({_NEW}) WHERE _id NOT IN (SELECT _id FROM ({_OLD}))"
_CHANGED = f"SELECT * FROM ({_NEW}) WHERE _id IN (SELECT _id FROM ({_OLD}))"
for _name, _method, _sql in (
    ("dml_upsert", "update", f"{_KEPT} UNION ALL {_NEW}"),
    ("dml_insert", "insert", f"{_OLD} UNION ALL {_ADDED}"),
    ("dml_replace", "replace", f"{_KEPT} UNION ALL {_CHANGED}"),
):

    def _run(spark: SparkSession, sf_dir: str, m: str = _method) -> DataFrame:
        s = _store(spark, sf_dir)
        getattr(s, m)(_incoming(spark, sf_dir))
        return _fields(s)

    add(_name, _sql)(_run)


@add("dml_update_if", f"SELECT _id, CASE WHEN seg = 'BUILDING' THEN 0.0 ELSE bal END AS bal, CASE WHEN seg = 'BUILDING' THEN NULL ELSE seg END AS seg FROM ({_OLD})")
def dml_update_if(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _store(spark, sf_dir)
    s.update_if(Q.seg == "BUILDING", {"bal": 0.0, "seg": None})
    return _fields(s)


@add("dml_remove", f"SELECT * FROM ({_OLD}) WHERE bal >= 0")
def dml_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _store(spark, sf_dir)
    s.remove(Q.bal < 0)
    return _fields(s)


@add("dml_undo", _OLD)
def dml_undo(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _store(spark, sf_dir)
    s.replace(_incoming(spark, sf_dir))
    s.revert()
    return _fields(s)


@add("dml_rename", f"SELECT CASE WHEN _id = '3' THEN 'three' ELSE _id END AS _id, bal, seg FROM ({_OLD})")
def dml_rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _store(spark, sf_dir)
    s.rename({"3": "three", "4": "5"})
    return _fields(s)


@add("ttl_filter", "SELECT o_orderkey FROM orders WHERE NOT (o_orderkey % 3 > 0 AND DATE '1998-08-01' > o_orderdate::DATE + (o_orderkey % 3)::INT * 30)")
def ttl_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = orders(spark, sf_dir)
    return Collection(c.df.withColumn("_ttl", (F.col("o_orderkey") % 3 * 30 * 1440).cast("int")), AS_OF).find().df.select("o_orderkey")


@add("flags_filter", "SELECT o_orderkey FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0")
def flags_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Read-only, not user flag 0, and not hidden."""
    c = orders(spark, sf_dir)
    k = F.col("o_orderkey")
    bit = lambda test, letter: F.when(test, mask(letter)).otherwise(0)
    df = c.df.withColumn("_flags", (bit(k % 2 == 0, "r") + bit(k % 5 == 0, "0") + bit(k % 7 == 0, "h")).cast("int"))
    return Collection(df, AS_OF).find(key_flags="+r-0").df.select("o_orderkey")


@add(
    "link_deref",
    "SELECT n_nationkey::VARCHAR AS _id, CASE WHEN n_nationkey % 4 = 1 THEN (SELECT r_name FROM region WHERE r_regionkey = n_regionkey) ELSE n_name END AS value FROM nation",
)
def link_deref(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = frame(spark, sf_dir, "nation"), frame(spark, sf_dir, "region")
    link = F.col("n_nationkey") % 4 == 1
    a = n.select(F.lit("").alias("_group"), F.col("n_nationkey").cast("string").alias("_id"), F.when(link, mask("l")).otherwise(0).alias("_flags"), F.when(link, F.concat(F.lit("regions:::"), F.col("n_regionkey").cast("string"))).otherwise(F.col("n_name")).alias("_json"))
    b = r.select(F.lit("regions").alias("_group"), F.col("r_regionkey").cast("string").alias("_id"), F.lit(0).alias("_flags"), F.col("r_name").alias("_json"))
    return follow_links(a.union(b)).where("_group = ''").select("_id", F.col("_json").alias("value"))


@add("group_fanout", "SELECT c_mktsegment AS grp, c_custkey::VARCHAR AS _id FROM customer WHERE regexp_matches(c_mktsegment, '^(BUILDING|MACHINERY)$') AND regexp_matches(c_custkey::VARCHAR, '1$')")
def group_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = customers(spark, sf_dir)
    found = Collection(c.df.withColumn("_group", F.col("c_mktsegment"))).find("^(BUILDING|MACHINERY)$:::1$")
    return found.df.select(F.col("_group").alias("grp"), "_id")


# ---- sources and sinks -------------------------------------------------------------------------------------
@add("io_csv_roundtrip", "SELECT c_custkey::VARCHAR AS _id, c_name, c_mktsegment FROM customer")
def io_csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.plans.storage import ensure_checkpoint_dir
    from tessera.sources.readers import from_csv
    from tessera.sources.writers import to_csv

    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/csv-roundtrip"
    c = customers(spark, sf_dir)
    to_csv(Collection(c.df.select("_id", "_row", "c_name", "c_mktsegment")), path)
    return from_csv(spark, path)


@add("io_parquet_cols", "SELECT p_partkey::VARCHAR AS _id, p_brand FROM part")
def io_parquet_cols(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.sources.readers import from_parquet

    return from_parquet(spark, f"{sf_dir}/part.parquet", columns=["p_brand"])


@add("map_udf", "SELECT p_partkey::VARCHAR AS _id, p_name || ':' || p_size AS out FROM part WHERE p_size > 25")
def map_udf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parts(spark, sf_dir).map(lambda k, v: f"{v['p_name']}:{v['p_size']}", "string", vals=Q.p_size > 25)


@add("info_counts", "SELECT count(*) AS records, min(o_orderdate::DATE - 10)::DATE::VARCHAR AS first_created, max(o_orderdate::DATE)::VARCHAR AS last_modified FROM orders")
def info_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders(spark, sf_dir).info().select("records", F.col("first_created").cast("string").alias("first_created"), F.col("last_modified").cast("string").alias("last_modified"))


# ---- graphs ---------------------------------------------------------------------------------------------------
def user_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Users in order of consecutive events: directed edges from each event's user to the next one's."""
    e = frame(spark, sf_dir, "events")
    nxt = e.select((F.col("event_id") - 1).alias("event_id"), F.col("user_id").alias("dst"))
    pairs = e.join(nxt, "event_id").where("user_id <> dst")
    pairs = pairs.groupBy(F.col("user_id").cast("string").alias("src"), F.col("dst").cast("string").alias("dst")).agg(F.round(F.min("value"), 2).alias("weight"))
    return Graph.from_edges(pairs)


def tree_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Region to nation to supplier, directed."""
    n, s = frame(spark, sf_dir, "nation"), frame(spark, sf_dir, "supplier")
    a = n.select(F.concat(F.lit("r"), F.col("n_regionkey")).alias("src"), F.concat(F.lit("n"), F.col("n_nationkey")).alias("dst"))
    b = s.select(F.concat(F.lit("n"), F.col("s_nationkey")).alias("src"), F.concat(F.lit("s"), F.col("s_suppkey")).alias("dst"))
    return Graph.from_edges(a.union(b))


def pair_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """The user graph without directions."""
    return Graph.from_edges(user_graph(spark, sf_dir).edges.drop("directed"), directed=False)


_UG = """WITH RECURSIVE nx AS (SELECT user_id AS a, lead(user_id) OVER (ORDER BY event_id) AS b, value FROM events),
e AS (SELECT a::VARCHAR AS src, b::VARCHAR AS dst, round(min(value), 2) AS weight FROM nx WHERE b IS NOT NULL AND a <> b GROUP BY 1, 2),
n AS (SELECT src AS id FROM e UNION SELECT dst FROM e),
p AS (SELECT src AS u, dst AS v FROM e UNION SELECT dst, src FROM e)"""
_TG = """WITH RECURSIVE e AS (SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst FROM nation UNION SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier),
n AS (SELECT src AS id FROM e UNION SELECT dst FROM e)"""


@add("g_degree", f"{_UG} SELECT id, (SELECT count(*) FROM e WHERE dst = id) AS \"in\", (SELECT count(*) FROM e WHERE src = id) AS \"out\", (SELECT count(*) FROM e WHERE src = id OR dst = id) AS total FROM n")
def g_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return user_graph(spark, sf_dir).degree().drop("undirected")


@add("g_wdegree", f"{_UG} SELECT id, round(coalesce((SELECT sum(weight) FROM e WHERE dst = id), 0) + coalesce((SELECT sum(weight) FROM e WHERE src = id), 0), 2) AS total FROM n")
def g_wdegree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return user_graph(spark, sf_dir).weighted_degree().select("id", F.round("total", 2).alias("total"))


@add("g_neighbors", f"{_UG} SELECT v AS id FROM p WHERE u = '8'")
def g_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return user_graph(spark, sf_dir).neighbors("8")


@add("g_common", f"{_UG} SELECT v AS id FROM p WHERE u = '8' INTERSECT SELECT v FROM p WHERE u = '16'")
def g_common(spark: SparkSession, sf_dir: str) -> DataFrame:
    return user_graph(spark, sf_dir).common_neighbors("8", "16")


@add(
    "g_jaccard",
    f"{_UG}, k AS (SELECT u, count(*) AS d FROM p GROUP BY 1), c AS (SELECT x.u AS a, y.u AS b, count(*) AS common FROM p x JOIN p y ON x.v = y.v AND x.u < y.u GROUP BY 1, 2) SELECT a, b, common, round(common / (ka.d + kb.d - common), 6) AS jaccard FROM c JOIN k ka ON ka.u = a JOIN k kb ON kb.u = b",
)
def g_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return user_graph(spark, sf_dir).common_counts().withColumn("jaccard", F.round("jaccard", 6))


_HOPS = "d AS (SELECT '8' AS id, 0 AS dist UNION SELECT {v}, dist + 1 FROM d JOIN {t} ON {u} = id WHERE dist < {k})"


@add("g_khop", f"{_UG}, {_HOPS.format(v='v', u='u', t='p', k=2)} SELECT id, min(dist) AS dist FROM d GROUP BY 1 HAVING id <> '8'")
def g_khop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return user_graph(spark, sf_dir).k_hop_neighbors("8", 2)


_REACH = "d AS (SELECT '{s}' AS id UNION SELECT {v} FROM d JOIN e ON {u} = id)"


@add("g_desc", f"{_TG}, {_REACH.format(s='r1', v='dst', u='src')} SELECT id FROM d WHERE id <> 'r1'")
def g_desc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree_graph(spark, sf_dir).descendants("r1")


@add("g_anc", f"{_TG}, {_REACH.format(s='s3', v='src', u='dst')} SELECT id FROM d WHERE id <> 's3'")
def g_anc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree_graph(spark, sf_dir).ancestors("s3")


@add("g_cc", f"{_TG}, b AS (SELECT src AS u, dst AS v FROM e UNION SELECT dst, src FROM e), d AS (SELECT id, id AS c FROM n UNION SELECT v, c FROM d JOIN b ON u = id) SELECT id, min(c) AS component FROM d GROUP BY 1")
def g_cc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree_graph(spark, sf_dir).connected_components()


@add("g_scc", f"{_UG}, d AS (SELECT id, id AS c FROM n UNION SELECT dst, c FROM d JOIN e ON src = id) SELECT x.id, min(x.c) AS component FROM d x JOIN d y ON x.id = y.c AND x.c = y.id GROUP BY 1")
def g_scc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return user_graph(spark, sf_dir).strongly_connected_components()


@add("g_bfs", f"{_UG}, {_HOPS.format(v='dst', u='src', t='e', k=8)} SELECT id, min(dist) AS dist FROM d GROUP BY 1")
def g_bfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return user_graph(spark, sf_dir).distances("8", "out").select("id", "dist")


@add(
    "g_dijkstra",
    f"{_UG}, r AS (SELECT '8' AS id, 0.0::DOUBLE AS d, 0 AS k UNION ALL SELECT id, min(d), k FROM (SELECT dst AS id, r.d + weight AS d, r.k + 1 AS k FROM r JOIN e ON src = r.id WHERE r.k < 30) GROUP BY id, k) SELECT id, round(min(d), 2) AS dist FROM r GROUP BY 1",
)
def g_dijkstra(spark: SparkSession, sf_dir: str) -> DataFrame:
    return user_graph(spark, sf_dir).distances("8", "out", weight="weight").select("id", F.round("dist", 2).alias("dist"))


@add(
    "g_allsp",
    f"{_UG}, {_HOPS.format(v='dst', u='src', t='e', k=8)}, m AS (SELECT id, min(dist) AS dist FROM d GROUP BY 1), r AS (SELECT ['8'] AS path, '8' AS tip UNION ALL SELECT list_append(path, dst), dst FROM r JOIN e ON src = tip JOIN m x ON x.id = src JOIN m y ON y.id = dst WHERE y.dist = x.dist + 1 AND y.dist <= (SELECT dist FROM m WHERE id = '140')) SELECT array_to_string(path, '>') AS path FROM r WHERE tip = '140'",
)
def g_allsp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return user_graph(spark, sf_dir).all_shortest_paths("8", "140").select(F.array_join("path", ">").alias("path"))


@add(
    "g_pagerank",
    f"{_UG}, t AS (SELECT src, sum(weight) AS t FROM e GROUP BY 1), r AS (SELECT id, 1.0::DOUBLE / (SELECT count(*) FROM n) AS rank, 0 AS k FROM n UNION ALL SELECT dst, 0.15 / (SELECT count(*) FROM n) + 0.85 * sum(rank * weight / t), k + 1 FROM r JOIN e ON e.src = r.id JOIN t ON t.src = r.id WHERE k < 80 GROUP BY dst, k) SELECT id, round(rank, 5) AS rank FROM r WHERE k = 80",
)
def g_pagerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return user_graph(spark, sf_dir).pagerank(tol=1e-8).select("id", F.round("rank", 5).alias("rank"))


_DIST = "d AS (SELECT id AS s, id, 0 AS k FROM n UNION SELECT s, {v}, k + 1 FROM d JOIN e ON {u} = id WHERE k < 7), m AS (SELECT s, id, min(k) AS k FROM d GROUP BY 1, 2)"


@add("g_closeness", f"{_TG}, {_DIST.format(v='src', u='dst')} SELECT s AS id, round(CASE WHEN sum(k) > 0 THEN (count(*) - 1) / sum(k) * (count(*) - 1) / ((SELECT count(*) FROM n) - 1) ELSE 0 END, 8) AS closeness FROM m GROUP BY 1")
def g_closeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree_graph(spark, sf_dir).closeness_centrality().select("id", F.round("closeness", 8).alias("closeness"))


@add("g_betweenness", f"{_TG}, d AS (SELECT src AS a, dst AS b FROM e UNION SELECT a, dst FROM d JOIN e ON src = b), t AS (SELECT x.b AS id, count(*) AS c FROM d x JOIN d y ON x.b = y.a GROUP BY 1) SELECT id, round(coalesce(c, 0) / ((SELECT count(*) FROM n) - 1) / ((SELECT count(*) FROM n) - 2), 8) AS betweenness FROM n LEFT JOIN t USING (id)")
def g_betweenness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree_graph(spark, sf_dir).betweenness_centrality().select("id", F.round("betweenness", 8).alias("betweenness"))


@add("g_edge_betweenness", f"{_TG}, d AS (SELECT id AS a, id AS b FROM n UNION SELECT a, dst FROM d JOIN e ON src = b), t AS (SELECT src, dst, count(*) AS c FROM e JOIN d x ON x.b = src JOIN d y ON y.a = dst GROUP BY 1, 2) SELECT src, dst, round(c / (SELECT count(*) FROM n) / ((SELECT count(*) FROM n) - 1), 8) AS betweenness FROM t")
def g_edge_betweenness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree_graph(spark, sf_dir).edge_betweenness_centrality().select("src", "dst", F.round("betweenness", 8).alias("betweenness"))


_TRI = "t AS (SELECT x.u AS id, count(*) AS c FROM p x JOIN p y ON x.u = y.u AND x.v <> y.v JOIN p z ON z.u = x.v AND z.v = y.v GROUP BY 1), k AS (SELECT u AS id, count(*) AS d FROM p GROUP BY 1)"


@add("g_cluster", f"{_UG}, {_TRI} SELECT id, round(CASE WHEN d > 1 THEN coalesce(c, 0) / (d * (d - 1)) ELSE 0 END, 8) AS clustering FROM k LEFT JOIN t USING (id)")
def g_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pair_graph(spark, sf_dir).clustering().select("id", F.round("clustering", 8).alias("clustering"))


@add(
    "g_cluster_directed",
    f"""{_UG}, m AS (SELECT u, v, count(*) AS m FROM (SELECT src AS u, dst AS v FROM e UNION ALL SELECT dst, src FROM e) GROUP BY 1, 2),
t AS (SELECT x.u AS id, sum(x.m * y.m * z.m) AS c FROM m x JOIN m y ON x.u = y.u AND x.v <> y.v JOIN m z ON z.u = x.v AND z.v = y.v GROUP BY 1),
k AS (SELECT u AS id, sum(m) AS d, count(*) FILTER (WHERE m = 2) AS r FROM m GROUP BY 1)
SELECT id, round(CASE WHEN d * (d - 1) - 2 * r > 0 THEN coalesce(c, 0) / (2.0 * (d * (d - 1) - 2 * r)) ELSE 0 END, 8) AS clustering FROM k LEFT JOIN t USING (id)""",
)
def g_cluster_directed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return user_graph(spark, sf_dir).clustering().select("id", F.round("clustering", 8).alias("clustering"))


@add("g_transitivity", f"{_UG}, {_TRI} SELECT round((SELECT sum(c) FROM t) / (SELECT sum(d * (d - 1)) FROM k), 8) AS transitivity")
def g_transitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _one(spark, transitivity=round(pair_graph(spark, sf_dir).transitivity(), 8))


@add("g_density", f"{_UG} SELECT round((SELECT count(*) FROM e) / (SELECT count(*) * (count(*) - 1) FROM n), 8) AS density, (SELECT count(*) FROM n) AS nodes, (SELECT count(*) FROM e) AS edges")
def g_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = user_graph(spark, sf_dir)
    return _one(spark, density=round(g.density(), 8), nodes=g.number_of_nodes(), edges=g.number_of_edges())


@add("g_degree_cent", f"{_UG} SELECT id, round((SELECT count(*) FROM e WHERE src = id OR dst = id) / ((SELECT count(*) FROM n) - 1), 8) AS centrality FROM n")
def g_degree_cent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return user_graph(spark, sf_dir).degree_centrality().select("id", F.round("centrality", 8).alias("centrality"))


@add("g_topo_levels", f"{_TG} SELECT id, CASE id[1] WHEN 'r' THEN 0 WHEN 'n' THEN 1 ELSE 2 END AS level FROM n")
def g_topo_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree_graph(spark, sf_dir).topological_levels()


@add("g_subgraph", f"{_UG} SELECT src, dst FROM e WHERE src::INT < 40 AND dst::INT < 40")
def g_subgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return user_graph(spark, sf_dir).subgraph([str(k) for k in range(40)]).edges.select("src", "dst")


@add("g_ego", f"{_UG}, s AS (SELECT '8' AS id UNION SELECT v FROM p WHERE u = '8') SELECT src, dst FROM e WHERE src IN (SELECT id FROM s) AND dst IN (SELECT id FROM s)")
def g_ego(spark: SparkSession, sf_dir: str) -> DataFrame:
    return user_graph(spark, sf_dir).ego_graph("8", 1).edges.select("src", "dst")


@add("g_successors", f"{_UG} SELECT dst AS id, weight FROM e WHERE src = '16'")
def g_successors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return user_graph(spark, sf_dir).successors("16").select("id", "weight")


@add("g_find_edges", f"{_UG} SELECT src, '>' AS kind, dst, weight FROM e WHERE weight < 3")
def g_find_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return user_graph(spark, sf_dir).find_edges(Q.weight < 3).select("src", "kind", "dst", "weight")


@add("g_remove_node", f"{_UG} SELECT src, dst FROM e WHERE src <> '8' AND dst <> '8'")
def g_remove_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    return user_graph(spark, sf_dir).remove_nodes(["8"]).edges.select("src", "dst")


@add("g_verify", f"{_UG} SELECT src, dst FROM e WHERE src = '8' OR dst = '8'")
def g_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = user_graph(spark, sf_dir)
    return Graph(g.nodes.where("id <> '8'"), g.edges).verify_index().select("src", "dst")


@add("g_cyclic", "SELECT true AS users, false AS tree")
def g_cyclic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _one(spark, users=user_graph(spark, sf_dir).is_cyclic(), tree=tree_graph(spark, sf_dir).is_cyclic())


from tessera import catalog_more  # noqa: E402, F401 - registers the rest
