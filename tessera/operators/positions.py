"""Positions of records in row order without sorting everything in one task."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows numbered together; the number of ranges follows the number of rows.
RANGE_ROWS, MAX_RANGES = 100_000, 1 << 15


def _place(value: Column, edges: list[float]) -> Column:
    """How many edges are at or below a value: a search in two levels, not along all of them."""
    step = max(1, math.isqrt(len(edges)))
    blocks = [edges[k : k + step] for k in range(0, len(edges), step)]
    if len(blocks) < 2:
        return F.size(F.filter(F.lit(edges), lambda x: x <= value)) if edges else F.lit(0)
    table = F.from_json(F.lit(json.dumps(blocks)), "array<array<double>>")
    block = F.size(F.filter(F.lit([b[0] for b in blocks[1:]]), lambda x: x <= value))
    return block * step + F.size(F.filter(F.get(table, block), lambda x: x <= value))


def with_position(df: DataFrame, order: str, out: str, total: int | None = None) -> DataFrame:
    """``df`` with ``out``: the 0-based position by the long column ``order``.

    The order's values are cut into ranges at approximate quantiles; rows are numbered within
    their range, and counts of the ranges before (one small table) are added. Any cut gives the
    same positions, as long as equal values fall together.
    """
    n = df.count() if total is None else total
    parts = min(MAX_RANGES, max(1, -(-n // RANGE_ROWS)))
    if parts == 1:  # few enough for one task
        return df.withColumn(out, F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(order)) - 1)
    edges = sorted(set(df.approxQuantile(order, [k / parts for k in range(1, parts)], 0.2 / parts)))
    df = df.withColumn("__range", _place(F.col(order).cast("double"), edges))
    counts = df.groupBy("__range").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    own = F.row_number().over(Window.partitionBy("__range").orderBy(order)) - 1
    return df.withColumn("__own", own).join(counts, "__range").withColumn(out, F.col("__before") + F.col("__own")).drop("__range", "__own", "__before")
