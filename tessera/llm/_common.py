"""Helpers shared by the training-data operators: shared storage, identities, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Runs of anything but ASCII white space; the word of every operator here.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share.

    A cluster names it in ``spark.checkpoint.dir``. Only on one machine (tests) a temporary folder
    takes its place; a cluster that names none is refused.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; it goes when the JVM ends."""
    path = f"{shared_dir(spark)}/tessera-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}-{name}"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def remove_path(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    Cuts lineage so that work survives lost executors, and gives the planner the true size,
    so that joins are broadcast only below ``spark.sql.autoBroadcastJoinThreshold``.
    """
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def path_of(df: DataFrame) -> str:
    """Folder of a table written by :func:`materialize`."""
    return df.inputFiles()[0].rsplit("/", 1)[0] if df.inputFiles() else ""


def small_batches(spark: SparkSession, rows: int = 1000, size: str = "8m") -> None:
    """Bound what a Python worker is handed at once: whole texts can be long."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def own_columns(df: DataFrame) -> list[Column]:
    """The columns of a frame, whatever their names hold."""
    return [quoted(c) for c in df.columns]


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def identity(*names: str) -> Column:
    """128-bit identity of a row's values, as 32 hex digits; nulls and empty strings differ."""
    parts = [x for n in names for x in (F.col(n), F.col(n).isNull())]
    return F.concat(*[F.lpad(F.hex(F.xxhash64(*seed, *parts)), 16, "0") for seed in ([], [F.lit("second")])])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def connected_components(links: DataFrame) -> DataFrame:
    """Components of the undirected graph ``links(a, b)`` of longs.

    Returns (node, root): every node named in a link, with the smallest node of its component.
    Alternating large-star and small-star steps; each is one partial aggregation and one
    equi-join on a node (adaptive execution splits a hub's rows), so no component is ever
    gathered in one task or on the driver.
    """
    spark = links.sparkSession
    edges = materialize(
        links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )
    seen = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            break
        seen = state
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select("u", F.col("m").alias("v")).union(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        old, edges = edges, materialize(small.where("u <> v").distinct(), "edges")
        remove_path(spark, path_of(old))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
