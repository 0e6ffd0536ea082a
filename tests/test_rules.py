"""The rule language: golden examples, and the compilers against the interpreter."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.collection import Collection
from tessera.plans import interpret, native, variant
from tessera.plans.query import Condition, Query
from tessera.plans.row import RowColumns
from tessera.plans.rules import parse

USERS = {
    "user_1": {"name": "Alice", "age": 30, "email": "alice@example.com", "role": "admin", "tags": ["python", "database"]},
    "user_2": {"name": "Bob", "age": 25, "role": "developer", "tags": ["javascript", "web"]},
    "user_3": {"name": "Charlie", "age": 35, "role": "developer", "tags": ["python", "linux", "aws"]},
    "user_4": {"name": "Diana", "age": 28, "email": "diana@test.com", "role": "designer", "tags": ["ui", "ux"]},
}
U = Query()
GOLDEN = [
    (dict(ANY="Alice"), "1"),
    (dict(vals={"name": "Alice"}), "1"),
    (dict(RE="designer"), "4"),
    (dict(RE2="role:designer"), "4"),
    (dict(vals={"role.$re": "d.+ner"}), "4"),
    (dict(vals={"age": {"$gte": 30}}), "13"),
    (dict(vals={"age.$ge": 30}), "13"),
    (dict(vals={"age": {"$lt": 30}}), "24"),
    (dict(vals={"role": ["admin", "designer"]}), "14"),
    (dict(vals={"tags.$has": "python"}), "13"),
    (dict(vals={"age": {"$ne": 30}}), "234"),
    (dict(vals={"!age": 30}), "234"),
    (dict(vals={"age": 28}), "4"),
    (dict(vals={"age": {"$gt": 25, "$lte": 40}}), "134"),
    (dict(vals={"age.$between": (26, 40)}), "134"),
    (dict(AND=[{"age": {"$gte": 25}}, {"age": {"$lte": 30}}]), "124"),
    (dict(OR=[{"role": "admin"}, {"age": {"$gt": 30}}]), "13"),
    (dict(OR=[{"r*e": "admin"}, {"age.$gt": 30}]), "13"),
    (dict(NOR=[{"role": "admin"}, {"age.$gt": 30}]), "24"),
    (dict(NOT={"role": "developer"}), "14"),
    (dict(vals={"!role": "developer"}), "14"),
    (dict(vals={"$or": [{"role": "admin"}, {"age.$gt": 30}], "!tags.$has": "linux"}), "1"),
    (dict(vals={"email": re.compile(r".@example.com")}), "1"),
    (dict(ANY=re.compile(r".@example.com")), "1"),
    (dict(RE=r"li[a-z]"), "13"),
    (dict(keys=re.compile(r"^user_[1-2]$")), "12"),
    (dict(vals={"tags.$size": 2}), "124"),
    (dict(vals={"tags": {"$0": "python"}}), "13"),
    (dict(vals={"tags.0": "python"}), "13"),
    (dict(vals={"tags.-1": "ux"}), "4"),
    (dict(vals={"age.$mod": (2, 0)}, limit=1), "1"),
    (dict(vals={"email": lambda v: v != ""}), "14"),
    (dict(EXISTS="email"), "14"),
    (dict(NOT={"email": lambda v: v != ""}), "23"),
    (dict(vals={"!$exists": "email"}), "23"),
    (dict(vals=U.age > 28), "13"),
    (dict(vals=(U.role == "developer") & (U.age < 30) | (U.role == "admin")), "12"),
    (dict(vals=U["**"].matches(r".@example\.com")), "1"),
    (dict(vals=~U.exists("email")), "23"),
    (dict(vals=U.name.lower().startswith("c")), "3"),
    (dict(vals=U.tags.len() > 2), "3"),
    (dict(vals={"tags.*.$sw": "ja"}), "2"),
]


@pytest.fixture(scope="module")
def docs(spark):
    plain = Collection.from_records(spark, USERS)
    return {"documents": plain, "typed": plain.typed()}


@pytest.mark.parametrize("mode", ["documents", "typed"])
def test_golden_examples(docs, mode):
    for find, want in GOLDEN:
        assert "".join(sorted(k[-1] for k in docs[mode].find(**find).to_dict())) == want, find


def test_callable_with_key(docs):
    assert list(docs["documents"].find(FUNC=lambda k, v: v.get("age") % 2 == 0 and k != "user_1").to_dict()) == ["user_4"]


def test_sort_group_and_unknown_argument(docs):
    for c in docs.values():
        assert [r._id for r in c.find(U.age.test(lambda a: a % 2 == 0), sort=U.name, reverse=True).df.collect()] == ["user_4", "user_1"]
        by = {r._id: r for r in c.find(group_by={"role": ["name", "age.$avg"]}).df.collect()}
        assert by["developer"].name == ["Bob", "Charlie"] and by["developer"].age == 30.0
        first = c.find(group_by="role.$len").df.orderBy("_row").collect()
        assert [r._id for r in first] == ["admin", "developer", "designer"] and first[1].email == 0
        with pytest.raises(TypeError):
            c.find(NOPE=1)


# ---- compilers against the interpreter ---------------------------------------------------------
_L, _D, _S = T.LongType(), T.DoubleType(), T.StringType()
_O = T.StructType([T.StructField("x", _L), T.StructField("y", _S), T.StructField("z", T.ArrayType(_D))])
SCHEMA = T.StructType([T.StructField(n, t) for n, t in (("i", _L), ("d", _D), ("s", _S), ("b", T.BooleanType()), ("a", T.ArrayType(_L)), ("t", T.ArrayType(_S)), ("o", _O))])


def documents(n=60):
    rng = random.Random(4)
    pick = lambda *xs: rng.choice([None, *xs])
    out = []
    for _ in range(n):
        out.append({
            "i": pick(-7, -1, 0, 1, 2, 5, 30), "d": pick(-2.5, -0.5, 0.5, 1.5, 2.5, 30.0), "s": pick("", "abc", "ABC", "a.c", "30", " x "), "b": pick(True, False),
            "a": pick([], [1], [3, 1, 2], [2, 2, 5, 7]), "t": pick([], ["a"], ["b", "a", "b"]),
            "o": pick({"x": 1, "y": "q", "z": [0.5]}, {"x": 5, "y": "abc", "z": []}, {"x": 0, "y": "", "z": [1.0, 2.0]}),
        })
    return [{k: v for k, v in d.items() if v is not None} for d in out]


LEAF = [
    {"$eq": 1}, {"$eq": True}, {"$eq": "abc"}, {"$ne": 30}, {"$ne": "abc"}, {"$gt": 0}, {"$gte": 1.5}, {"$lt": "b"}, {"$lte": 2}, {"!$gt": 1}, {"$between": (0, 5)}, {"$near": (1, 1)}, {"$mod": (3, 2)},
    {"$mod": (-3, -1)}, {"$in": [1, 2, "abc"]}, {"$nin": [1, 2]}, {"$anyin": [1, 7]}, {"$has": "b"}, {"$has": 1}, {"$nhas": "a"}, {"$ihas": "B"}, {"$sw": ("a", "A")}, {"$ew": "c"}, {"$re": "^a"},
    {"$match": "a.c"}, {"$size": 3}, {"$size": [0, 1]}, {"$type": "int"}, {"$type": "str"}, {"$type": "list"}, {"$any": {"$gt": 2}}, {"$all": {"$lt": 4}}, {"$none": {"$eq": 2}}, {"$0": 3}, {"!$0": {"$gt": 1}},
    {"$abs": {"$gt": 1}}, {"$round": 2}, {"$ceil": 1}, {"$floor": {"$lt": 0}}, {"$neg": {"$gt": 0}}, {"$int": 30}, {"$float": 30.0}, {"$str": "30"}, {"$str": "2.5"}, {"$str": "True"}, {"$lower": "abc"},
    {"$upper": "ABC"}, {"$strip": "x"}, {"$len": 3}, {"$avg": 2.0}, {"$std": {"$gt": 0.5}}, {"$sum": 6}, {"$min": 1}, {"$max": {"$gte": 3}}, {"$mid": 1}, {"$first": 3}, {"$last": {"$in": [2, 7]}},
    {"$sort": {"$0": 1}}, {"$unique": {"$size": 3}}, {"$not": {"$gt": 1}}, {"$and": [{"$gt": 0}, {"$lt": 3}]}, {"$or": [{"$eq": 0}, {"$eq": "abc"}]}, {"$nor": [{"$eq": 0}]}, {"$and": []}, {"$or": []}, {}, {"$nand": [{"$eq": 1}]},
    None, 1, "abc", [1, 2], re.compile("b"),
]
PATHED = [
    {"o.x": 1}, {"o.x.$gt": 0}, {"!o.x": 1}, {"o/y": "q"}, {"o.y.$upper.$has": "A"}, {"o.z.0.$gt": 0}, {"o.z.-1": 2.0}, {"o.*": 5}, {"o.?": "abc"}, {"*.x": 5}, {"**": "abc"}, {"**.$gt": 6}, {"!**": 30}, {"a.*.$gt": 4},
    {"$exists": "s"}, {"!$exists": ["s", "i"]}, {"nope": 1}, {"!nope": 1}, {"$not": {"nope": 1}}, {"o": {"x": 5, "y.$len": 3}}, {"s.$lower": "abc", "i.$ne": 1}, {"$any": {"$eq": 5}}, {"$all": {"$ne": 5}}, {"$any": {"i": 1}},
    {"a.$sum.$mod": (2, 0)}, {"a.0": 3}, {"a.$sort.0": 1}, {"t.$unique.$size": 2}, {"i.$float.$str": "1.0"}, {"!s.$sw": "a"},
]


@pytest.fixture(scope="module")
def typed(spark):
    rows = documents()
    df = spark.createDataFrame([(str(k), *[d.get(n) for n in SCHEMA.names]) for k, d in enumerate(rows)], T.StructType([T.StructField("_id", T.StringType()), *SCHEMA.fields]))
    return rows, df.cache()


def test_typed_compiler_agrees_with_the_interpreter(typed):
    """A field that is absent from a document is null in a typed row; both are unresolved."""
    rows, df = typed
    on_keys = {"$lower", "$upper", "$strip", "$str", "$first", "$last"}  # of a mapping's keys, which a typed row always has
    rules = [{n: leaf} for n in SCHEMA.names for leaf in LEAF if not (n == "o" and isinstance(leaf, dict) and on_keys & set(leaf))] + PATHED
    tests = [native.compiled(parse(r), RowColumns(SCHEMA), SCHEMA, native.Scope(F.col("_id"))) for r in rules]
    for lo in range(0, len(tests), 60):
        got = df.select("_id", *[t.alias(f"c{k}") for k, t in enumerate(tests[lo : lo + 60])]).collect()
        for r in got:
            for k, rule in enumerate(rules[lo : lo + 60]):
                want = interpret.matches(parse(rule), rows[int(r._id)], interpret.Meta(r._id))
                assert r[f"c{k}"] == want, (rule, rows[int(r._id)])


def test_filters_reach_the_scan_and_mean_the_same(spark, sf, typed):
    rows, df = typed
    for r in [{n: leaf} for n in SCHEMA.names for leaf in LEAF[::4]] + PATHED:
        test = native.compiled(parse(r), RowColumns(SCHEMA), SCHEMA, native.Scope(F.col("_id"), loose=True))
        strict = native.compiled(parse(r), RowColumns(SCHEMA), SCHEMA, native.Scope(F.col("_id")))
        assert df.where(F.coalesce(test, F.lit(False)) != strict).isEmpty(), r
    c = Collection.from_frame(spark.read.parquet(f"{sf}/orders.parquet"), "o_orderkey")
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    found = c.find(vals={"o_orderstatus": "F", "o_totalprice.$gt": 1000, "o_orderpriority.$sw": "1"})
    plan = found.df.select("o_custkey")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_orderstatus,F)" in plan and "GreaterThan(o_totalprice,1000.0)" in plan and "StringStartsWith(o_orderpriority,1)" in plan
    assert "o_orderdate" not in plan


def test_variant_compiler_agrees_with_the_interpreter(spark):
    rows = documents()
    df = spark.createDataFrame([(str(k), interpret.json_text(d)) for k, d in enumerate(rows)], "_id string, _json string")
    rules = [r for r in [{n: leaf} for n in SCHEMA.names for leaf in LEAF] + PATHED if variant.compiled(parse(r), F.parse_json("_json")) is not None]
    assert len(rules) > 100
    for lo in range(0, len(rules), 80):
        part = rules[lo : lo + 80]
        for r in df.select("_id", *[variant.compiled(parse(x), F.parse_json("_json")).alias(f"c{k}") for k, x in enumerate(part)]).collect():
            for k, rule in enumerate(part):
                assert r[f"c{k}"] == interpret.matches(parse(rule), rows[int(r._id)]), (rule, rows[int(r._id)])


def test_builder():
    q = Query()
    assert isinstance(q.a == 1, Condition) and (q == 1) is False
    assert ((q.a == 1) & (q.b == 2) & (q.c == 3)).as_rule() == {"$and": [{"a.$eq": 1}, {"b.$eq": 2}, {"c.$eq": 3}]}
    assert (~(q["sum"].lower() == "x")).as_rule() == {"$not": {"sum.$lower.$eq": "x"}}


def test_dates(spark):
    rows = [(str(k), k, dt.date(2024, 1, 1) + dt.timedelta(k), dt.date(2024, 2, 1) + dt.timedelta(k)) for k in range(20)]
    c = Collection(spark.createDataFrame(rows, "_id string, v int, _cdate date, _mdate date"), dt.date(2024, 2, 10))
    ids = lambda **k: sorted(int(x) for x in c.find(**k).to_dict())
    assert ids(date=dt.date(2024, 2, 3)) == [2] and ids(date=dt.datetime(2024, 1, 3)) == [2]
    assert ids(date=0) == [9] and ids(date=-2) == [7, 8, 9] and ids(date=3) == [9, 10, 11, 12]
    assert ids(date={dt.date(2024, 1, 5), dt.date(2024, 2, 9)}) == [4, 8]
    assert ids(vals={"_date.$near": (dt.date(2024, 2, 5), 1)}) == [3, 4, 5]
    assert sorted(c[dt.date(2024, 2, 3) : dt.date(2024, 2, 5)].to_dict()) == ["2", "3"]
    assert sorted(c[: dt.datetime(2024, 1, 3)].to_dict()) == ["0", "1"]


def test_slices(spark):
    c = Collection.from_records(spark, {f"k{v}": v for v in range(30)})
    ks = lambda x: [int(k[1:]) for k in x.to_dict()]
    r = list(range(30))
    for s in (slice(5, 9), slice(None, 3), slice(-4, None), slice(2, -2, 5), slice(None, None, 7), slice(20, 4, -3), slice(-1, None, -10), slice(40, 50)):
        assert sorted(ks(c[s])) == sorted(r[s]), s
    assert ks(c[::r"[13]$"]) == [1, 3, 11, 13, 21, 23] and c["k4"] == 4 and c["zz"] is None
    assert ks(c[lambda k: k.endswith("7")]) == [7, 17, 27] and ks(c[lambda k, v: v == 5]) == [5]
    assert "k1" in c and {"k1", "k2"} in c and {"k1", "zz"} not in c and c.has_any({"zz", "k1"})


def test_positions_with_many_ranges(spark, monkeypatch):
    from tessera.operators import positions

    monkeypatch.setattr(positions, "RANGE_ROWS", 7)
    df = spark.range(200).select((F.col("id") * 37 % 211).alias("_row"))
    got = {r._row: r.at for r in positions.with_position(df, "_row", "at").collect()}
    assert [got[k] for k in sorted(got)] == list(range(200))
