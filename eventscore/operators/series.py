"""Windows, islands and fills over ordered rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def sliding(spark: SparkSession, length: float, hop: float, duration: float) -> DataFrame:
    """(pos, a, b): windows from 0 on, the last one cut at the duration; no window begins after one that reaches the end."""
    last = F.greatest(F.ceil((F.lit(duration) - length) / hop), F.lit(0))
    pos = spark.range(1).select(F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))).alias("pos"))
    return pos.select("pos", (F.col("pos") * hop).cast("double").alias("a"), F.least(F.col("pos") * hop + length, F.lit(duration)).cast("double").alias("b"))


def in_windows(df: DataFrame, on: str, length: float, hop: float, duration: float) -> DataFrame:
    """df exploded to the sliding windows [a, b) that hold it, found by arithmetic instead of a join: adds pos, a, b."""
    last = max(0, -int(-(duration - length) // hop))
    first = F.greatest(F.floor((F.col(on) - length) / hop) + 1, F.lit(0))
    upto = F.least(F.floor(F.col(on) / hop), F.lit(last))
    inside = df.where((F.col(on) >= 0) & (F.col(on) < duration)).where(first <= upto)
    return inside.withColumn("pos", F.explode(F.sequence(first.cast("long"), upto.cast("long")))).withColumn("a", (F.col("pos") * hop).cast("double")).withColumn("b", F.least(F.col("a") + length, F.lit(float(duration))))


def islands(df: DataFrame, by: list[str], order: list[str], starts: Column, name: str = "island") -> DataFrame:
    """Adds the running number of the islands that begin where `starts` (over lag() and the like) is true."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_s", F.coalesce(starts, F.lit(False)).cast("int")).withColumn(name, F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_s")


def merge_intervals(df: DataFrame, by: list[str], a: str, b: str, slack: float, order: list[str], *, most: list[str] = [], first: list[str] = []) -> DataFrame:  # noqa: B006
    """Intervals of a key that begin at most `slack` after the latest end so far become one; n rows, the most of the columns
    `most` (amplitudes), and of the columns `first` (bends) the first row's value."""
    w = Window.partitionBy(*by).orderBy(a, *order)
    reach = F.max(b).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = df.withColumn("_reach", reach)
    parts = islands(marked, by, [a, *order], F.col(a) > F.col("_reach") + slack)
    return parts.groupBy(*by, "island").agg(F.min(a).alias(a), F.max(b).alias(b), F.count("*").alias("n"), *(F.max(c).alias(c) for c in most), *(F.min_by(c, F.struct(a, *order)).alias(c) for c in first))


def nudge(df: DataFrame, by: list[str], on: str, order: list[str], step: float, name: str) -> DataFrame:
    """on, moved up so that each is at least `step` after the adjusted one before: a running maximum in closed form."""
    w = Window.partitionBy(*by).orderBy(on, *order)
    i = F.row_number().over(w) - 1
    shifted = df.withColumn("_i", i).withColumn("_x", F.col(on) - step * F.col("_i"))
    return shifted.withColumn(name, F.max("_x").over(w.rowsBetween(Window.unboundedPreceding, 0)) + step * F.col("_i")).drop("_i", "_x")


def fill_linear(df: DataFrame, by: list[str], order: str, value: str, name: str) -> DataFrame:
    """Nulls between two known values lie evenly between them by position; a run at the end stays null, one at the start takes the first."""
    w = Window.partitionBy(*by).orderBy(order)
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    at = F.when(F.col(value).isNotNull(), F.col("_i"))
    d = df.withColumn("_i", F.row_number().over(w))
    d = d.withColumn("_i0", F.last(at, True).over(back)).withColumn("_i1", F.first(at, True).over(ahead)).withColumn("_v0", F.last(value, True).over(back)).withColumn("_v1", F.first(value, True).over(ahead))
    between = F.col("_v0") + (F.col("_v1") - F.col("_v0")) * (F.col("_i") - F.col("_i0")) / F.nullif(F.col("_i1") - F.col("_i0"), F.lit(0))
    return d.withColumn(name, F.when(F.col(value).isNotNull(), F.col(value)).when(F.col("_v0").isNull(), F.col("_v1")).otherwise(between)).drop("_i", "_i0", "_i1", "_v0", "_v1")


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(name) <= k)
