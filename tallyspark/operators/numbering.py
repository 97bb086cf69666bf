"""Total orders without a task that sees all rows: row numbers and running sums over range partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tallyspark.sources.shared import cut

#: Fixed value: monotonically_increasing_id() has the place within a partition in its lower bits.
BITS = 33


def placed(df: DataFrame, order: list[Column]) -> DataFrame:
    """df in ranges of `order`, each sorted, with _part (the range) and _place (from 1 within it); kept in the shared
    folder, so that both stay as they are. Rows that agree in order come in any order, but never in two ranges."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = cut(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()))
    return rows.withColumns({"_part": F.shiftright("_id", BITS), "_place": F.col("_id").bitwiseAND(F.lit((1 << BITS) - 1)) + 1}).drop("_id")


def starts(rows: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """(_part, name...) with what the ranges before each range sum up to. One row for each range."""
    totals = rows.groupBy("_part").agg(*[F.sum(value).alias(name) for name, value in sums.items()])
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    return totals.select("_part", *[F.coalesce(F.sum(name).over(before), F.lit(0)).alias(name) for name in sums])


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with its row number, from 1, in `order`: the place in the range and the counts of the ranges before."""
    rows = placed(df, order)
    offset = starts(rows, {"_offset": F.lit(1)})
    return rows.join(F.broadcast(offset), "_part").withColumn(name, (F.col("_offset") + F.col("_place")).cast("long")).drop("_part", "_place", "_offset")


def running(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """df with, for each name, the sum of its column over all rows that come before in `order`; 0 for the first."""
    rows = placed(df, order)
    held = starts(rows, {f"_{name}": value for name, value in sums.items()})
    inside = W.partitionBy("_part").orderBy("_place").rowsBetween(W.unboundedPreceding, -1)
    out = rows.join(F.broadcast(held), "_part")
    for name, value in sums.items():
        out = out.withColumn(name, F.coalesce(F.sum(value).over(inside), F.lit(0)) + F.col(f"_{name}"))
    return out.drop("_part", "_place", *[f"_{name}" for name in sums])
