import dataclasses
import datetime as dt
import decimal
import enum
import sqlite3

import pytest
from pyspark.sql import functions as F

from tessera.functions.dataclasses import from_record, to_record
from tessera.operators.collection import Collection
from tessera.sources import readers, writers
from tessera.streaming.ingest import append_stream, changes_since, read_log, windowed_counts
from tessera.operators.history import live


def test_csv(spark, tmp_path):
    c = Collection.from_records(spark, {"a": {"x": 1, "t": ["p", "q"]}, "b": {"x": 2, "y": 'say "hi", ok'}})
    writers.to_csv(c, f"{tmp_path}/out", single=True)
    back = {r._id: r.asDict() for r in readers.from_csv(spark, f"{tmp_path}/out").collect()}
    assert back["a"]["x"] == "1" and back["a"]["t"] == '["p","q"]' and back["b"]["y"] == 'say "hi", ok'
    assert [r._id for r in readers.from_csv(spark, f"{tmp_path}/out", key="x").orderBy("_id").collect()] == ["1", "2"]


def test_pseudo_columns(spark, tmp_path):
    c = Collection.from_records(spark, {"a": {"x": 1}, "b": 7, "c": "text", "d": ["p", 2]})
    rows = {r._id: r.asDict() for r in writers.flat_frame(c).collect()}
    assert rows["a"]["x"] == 1 and rows["b"]["__1__"] == "7" and rows["c"]["__1__"] == "text"
    assert (rows["d"]["__V1__"], rows["d"]["__V2__"], rows["d"]["__1__"]) == ("p", "2", None)


def test_parquet_projection(spark, sf):
    df = readers.from_parquet(spark, f"{sf}/part.parquet", columns=["p_brand"])
    assert df.columns == ["_id", "p_brand"]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "p_name" not in plan


def test_sqlite(spark, tmp_path):
    with sqlite3.connect(f"{tmp_path}/x.db") as db:
        db.executescript("CREATE TABLE p (id INTEGER PRIMARY KEY, name TEXT); CREATE TABLE l (pid INTEGER, act TEXT); CREATE TABLE k (a TEXT, b INTEGER, v REAL, PRIMARY KEY (a, b)); CREATE TABLE e (z TEXT)")
        db.executemany("INSERT INTO p VALUES (?, ?)", [(1, "one"), (2, None)])
        db.executemany("INSERT INTO l VALUES (?, ?)", [(1, "x"), (1, "y"), (2, "z")])
        db.execute("INSERT INTO k VALUES ('q', 7, 1.5)")
    out = readers.from_sqlite(spark, f"{tmp_path}/x.db", batch=2)
    assert {(r._group, r._id, r.name) for r in out["p"].collect()} == {("p", "1", "one"), ("p", "2", None)}
    assert sorted(r._id for r in out["l"].collect()) == ["0", "1", "2"] and out["k"].first()._id == "q|7" and out["e"].count() == 0


def test_ini_and_toml(spark, tmp_path):
    (tmp_path / "a.ini").write_text("[server]\nHost = h\nport = 80\n")
    (tmp_path / "a.toml").write_text('app = "x"\n[net]\nip = "1.2.3.4"\nport = 80\n')
    assert {r._id: r._json for r in readers.from_ini(spark, f"{tmp_path}/a.ini").collect()} == {"server/Host": '"h"', "server/port": '"80"'}
    assert {r._id: r._json for r in readers.from_toml(spark, f"{tmp_path}/a.toml").collect()} == {"/app": '"x"', "net/ip": '"1.2.3.4"', "net/port": "80"}


@pytest.mark.parametrize("name", ["no", "gz", "bz", "xz", "z1"])
def test_codecs(name):
    value = {"a": [1, 2.5, None, "é"], "b": {"c": True}}
    assert writers.loads(writers.dumps(value, name), name) == value


def test_user_codec_and_backup(spark, tmp_path):
    df = spark.createDataFrame([("a", "text"), ("b", None)], "_id string, v string")
    coded = df.select("_id", writers.encoded("v", lambda s: s[::-1].encode()).alias("v"))
    writers.backup(coded, f"{tmp_path}/b", "zs")
    back = spark.read.parquet(f"{tmp_path}/b").select("_id", writers.decoded("v", lambda b: b.decode()[::-1]).alias("v"))
    assert {r._id: r.v for r in back.collect()} == {"a": "text", "b": None}
    for other in ("xz", "bz", "z1", "z2"):
        with pytest.raises(ValueError):
            writers.backup(coded, f"{tmp_path}/no", other)


class Role(enum.Enum):
    ADMIN = 1


@dataclasses.dataclass
class Address:
    city: str


@dataclasses.dataclass
class User:
    id: int
    name: str
    role: Role
    address: Address
    tags: list[str]
    joined: dt.date | None = None
    balance: decimal.Decimal = decimal.Decimal("0")


def test_dataclasses():
    u = User(7, "x", Role.ADMIN, Address("c"), ["t"], dt.date(2024, 1, 2), decimal.Decimal("1.50"))
    key, doc = to_record(u)
    assert key == "7" and doc == {"name": "x", "role": "ADMIN", "address": {"city": "c"}, "tags": ["t"], "joined": "2024-01-02", "balance": "1.50"}
    assert from_record(User, key, doc) == u


def test_streaming_ingest(spark, tmp_path):
    feed = tmp_path / "feed"
    for n, rows in enumerate(([("a", "1"), ("b", "2")], [("a", None), ("b", "3")])):
        spark.createDataFrame(rows, "_id string, _json string").coalesce(1).write.mode("append").parquet(str(feed))
        stream = spark.readStream.schema("_id string, _json string").parquet(str(feed))
        q = append_stream(stream, f"{tmp_path}/log", f"{tmp_path}/check")
        q.awaitTermination()
    assert {r._id: r._json for r in live(read_log(spark, f"{tmp_path}/log")).collect()} == {"b": "3"}
    assert {(r._id, r._op) for r in changes_since(spark, f"{tmp_path}/log", 1).collect()} == {("a", "del"), ("b", "put")}


def test_windowed_counts(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(f"{tmp_path}/e")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/e")
    q = windowed_counts(stream, "ts", "event_type", "1 day").writeStream.outputMode("complete").format("memory").queryName("counts").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("SELECT sum(n) FROM counts").first()[0] == events.count()
