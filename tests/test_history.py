import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tessera.functions.documents import grown, merged
from tessera.functions.flags import expired, mask, parse_flags, ttl_minutes
from tessera.operators.history import Store, follow_links, latest
from tessera.plans import interpret

DAY = dt.date(2024, 5, 1)


@pytest.fixture
def store(spark):
    return Store(spark, as_of=DAY)


def test_operators_and_undo(store):
    data = {f"key{v}": v for v in range(8)}
    store += data
    assert store.to_dict() == data and store.update(data) == 0
    store |= {f"key{v}": v + 1 for v in range(10)}
    assert store.to_dict() == {**data, "key8": 9, "key9": 10}
    assert store.view()[-2.0:].to_dict() == {"key8": 9, "key9": 10}
    store -= ["key8", "key9", "zz"]
    store &= {f"key{v}": v + 1 for v in range(20)}
    assert store.to_dict() == {k: v + 1 for k, v in data.items()}
    store ^= list(data)
    assert store.to_dict() == data
    store ^= list(data)  # an undo can be undone
    assert store.to_dict() == {k: v + 1 for k, v in data.items()}
    store[:] = 0
    assert set(store.to_dict().values()) == {0}
    store.remove(slice(None))
    assert store.to_dict() == {}
    store ^= data
    store[:] = lambda k, v: int(k[3:]) + v
    assert store.to_dict() == data
    assert store.view(version=9).to_dict() == data
    assert store.history("key1").count() == 8 and store.history("key0").count() == 7  # adding 0 to 0 is no change
    assert store.check_error().count() == 0
    store.recycle()
    assert store.to_dict() == data and store.log.count() == 8


def test_update_if_rename_and_keys(store):
    store += {"a": {"x": 1, "y": 2}, "b": {"x": 5}, "c": 3}
    assert store.update_if({"x.$gt": 0}, {"y": None, "z": 1}) == 2
    assert store.to_dict() == {"a": {"x": 1, "z": 1}, "b": {"x": 5, "z": 1}, "c": 3}
    assert store.update_if({"x": 5}, lambda k, v: None) == 1 and "b" not in store.to_dict()
    assert store.rename({"a": "d", "c": "d2"}) == 2 and store.rename({"d": "d2"}) == 0
    assert not store.setdefault("d", 1) and store.setdefault("e", 1)
    assert store.append(["p", "q"]) == 2 and store.pop("e") == 1
    assert store.clear() == 0 and store.clear("yes") == 4 and store.to_dict() == {}


def test_flags_ttl_and_checks(spark):
    s = Store(spark, as_of=DAY, check=lambda k, v: v != "bad")
    assert s.set("a", "bad") is False and s.set("a", [1], flags="a")
    assert s.set("a", [2]) is False and s.set("a", [1, 2]) and s.to_dict() == {"a": [1, 2]}
    s.set("r", 1, flags="r")
    assert s.set("r", 2) is False and s.remove("r") == 0
    s.set_flags("r", "-r+h")
    assert s.view().find().to_dict() == {"a": [1, 2]} and s.view().find(with_hidden=True).count() == 2
    s.set("t", 1, ttl=2)
    s.as_of = DAY + dt.timedelta(2)
    assert "t" in s.view().find().to_dict()
    s.as_of = DAY + dt.timedelta(3)
    assert "t" not in s.view().find().to_dict() and s.purge_expired() == 1
    assert {r._id for r in s.get_flags().collect()} == {"a", "r"}


def test_groups_and_links(store):
    store += {"x": 1, "y": {"k": 2}}
    red = store.in_group("red")
    red.update({"apple": {"qty": 5}, "cherry": {"qty": 7}})
    store.absorb(red)
    store.set_link("to_x", "x")
    store.set_link("to_apple", "red:::apple")
    store.set_link("nowhere", "gone")
    with pytest.raises(ValueError):
        store.set_link("again", "to_x")
    with pytest.raises(ValueError):
        store.in_group("not a name")
    got = {r._id: r._json for r in store.followed().df.collect()}
    assert got["to_x"] == "1" and got["to_apple"] == '{"qty":5}' and got["nowhere"] is None
    assert store.all_groups().find("red:::^a").to_dict() == {"apple": {"qty": 5}}
    assert store.del_group("red") == 2 and store.all_groups().find(":::").count() == 0


def test_snapshot_and_change_feed(spark, store, tmp_path):
    store += {"a": 1, "b": 2}
    at = store.version()
    store -= ["a"]
    store += {"c": 3}
    assert {(r._id, r._op) for r in store.changes(at).collect()} == {("a", "del"), ("c", "put")}
    store.save(f"{tmp_path}/log")
    assert Store.load(spark, f"{tmp_path}/log").to_dict() == {"b": 2, "c": 3}
    assert latest(store.log, at).count() == 2


def test_key_view(store):
    store += {"a": 1, "b": 2, "c": 3}
    store.keys["a"] = dt.date(2020, 1, 2)
    store.keys[lambda k: k != "a"] = (dt.date(2021, 1, 1), dt.date(2019, 1, 1))
    store.keys["c"] = dt.datetime(2018, 1, 1)
    got = {r._id: (r._cdate, r._mdate) for r in store.keys[:].collect()}
    assert got == {"a": (DAY, dt.date(2020, 1, 2)), "b": (dt.date(2019, 1, 1), dt.date(2021, 1, 1)), "c": (dt.date(2018, 1, 1), dt.date(2021, 1, 1))}
    assert store.to_dict() == {"a": 1, "b": 2, "c": 3} and store.check_version(1, 4).count() == 3
    assert {r._id for r in (store.keys & ["a", "z"]).collect()} == {"a"} and store.keys.find(vals={"$gt": 1}).count() == 2


def test_ttl_rules(spark):
    assert [ttl_minutes(x) for x in (None, 0, -1, 0.5, 1, 1.4, 2000, dt.timedelta(minutes=90))] == [0, 0, 0, 720, 1440, 1440, 511 * 1440, 90]
    df = spark.createDataFrame([(0, DAY, dt.datetime(2024, 5, 1, 10)), (1440, DAY, dt.datetime(2024, 5, 1, 10)), (30, DAY, dt.datetime(2024, 5, 1, 10))], "ttl int, d date, m timestamp_ntz")
    at = lambda now: [r[0] for r in df.select(expired(F.col("ttl"), F.col("d"), F.col("m"), now)).collect()]
    assert at(dt.datetime(2024, 5, 1, 10, 29)) == [False, False, False]
    assert at(dt.datetime(2024, 5, 1, 10, 31)) == [False, False, True]
    assert at(dt.datetime(2024, 5, 3)) == [False, True, True]


def test_flag_masks_and_extension():
    assert parse_flags("+r-0") == (mask("r"), mask("0")) and parse_flags("rh") == (mask("rh"), 0)
    with pytest.raises(ValueError):
        parse_flags("u")


def test_growth_of_append_only_records(spark):
    pairs = [("ab", "abc", True), ("ab", "ab", False), ("ab", "xab", False), ("", "a", True), ('q"', 'q"\n', True), ([1], [1, 2], True), ([], [0], True), ([], [], False), ([1], [12], False), ([1, 2], [1], False)]
    pairs += [({"a": 1}, {"a": 1, "b": 2}, True), ({"a": 1}, {"b": 2, "a": 1}, True), ({"a": 1}, {"a": 2, "b": 2}, False), ({}, {"a": 1}, True), ({"a": 1}, {"a": 1}, False), (1, 12, False), ("a", ["a", "b"], False), ({"a": {"x": [1]}}, {"a": {"x": [1]}, "c": None}, True)]
    df = spark.createDataFrame([(json.dumps(a), json.dumps(b), w) for a, b, w in pairs], "a string, b string, want boolean")
    assert [r for r in df.select("*", grown(F.col("a"), F.col("b")).alias("got")).collect() if r.got != r.want] == []


def test_merging_keeps_the_rest_as_it_is(spark):
    values = [{"x": 1, "y": "1", "z": 1.0, "q": 'say "hé"\n'}, {"y": None, "t": [1.50, "a", {"u": "v"}], "b": True}, {}, [1], "text", 5, None, {"new": {"deep": 1}, "x": 0}]
    patch = {"x": None, "new": {"k": [1, "é"]}, "y": "2"}
    df = spark.createDataFrame([(k, interpret.json_text(v)) for k, v in enumerate(values)], "k int, t string")
    for r in df.select("k", merged(F.col("t"), patch).alias("m")).collect():
        v = values[r.k]
        want = {k: x for k, x in {**v, **patch}.items() if x is not None or k not in patch} if isinstance(v, dict) else v
        got = json.loads(r.m)
        assert got == want and str(got) == str(want), r


def test_follow_links_is_one_level(spark):
    rows = [("", "a", mask("l"), '"b"'), ("", "b", mask("l"), '"c"'), ("", "c", 0, "1")]
    out = {r._id: r._json for r in follow_links(spark.createDataFrame(rows, "_group string, _id string, _flags int, _json string")).collect()}
    assert out == {"a": '"c"', "b": "1", "c": "1"}
