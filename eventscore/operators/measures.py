"""Levels and similarity measures. No evidence is null, never 0 or NaN."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def level_db(x: Column) -> Column:
    """RMS level in dB; null for silence."""
    return 20 * F.log10(F.nullif(F.sqrt(F.avg(x * x)), F.lit(0.0)))


def pearson(x: Column, y: Column) -> Column:
    """Correlation over the rows where both are known; null if one is flat."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    return F.covar_pop(a, b) / F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0))


def median_cents(ref: Column, est: Column, least: int = 10) -> Column:
    """Median |cents| between two positive series; null under `least` pairs."""
    ok = (ref > 0) & (est > 0)
    return F.when(F.count(F.when(ok, 1)) >= least, F.median(F.when(ok, F.abs(1200 * F.log2(est / ref)))))


def energy_share(df: DataFrame, by: list[str], part: str, value: str) -> DataFrame:
    """(by, part, energy): a part's share of the summed squares; 0 where there is no energy at all."""
    sums = df.groupBy(*by, part).agg(F.sum(F.col(value) * F.col(value)).alias("_e"))
    total = F.sum("_e").over(Window.partitionBy(*by))
    return sums.withColumn("energy", F.coalesce(F.col("_e") / F.nullif(total, F.lit(0.0)), F.lit(0.0))).drop("_e")


def pooled_cosine(frames: DataFrame, key: str, vector: str) -> DataFrame:
    """(a, b, cosine): ordered pairs of different keys, by the means of their vectors; null for a zero mean.
    Pairs are made of keys (parts, labels), never of frames."""
    mean = frames.select(key, F.posexplode(F.col(vector).cast("array<double>"))).groupBy(key, "pos").agg(F.avg("col").alias("v"))
    norm = mean.groupBy(key).agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("n"))
    a = mean.select(F.col(key).alias("a"), "pos", F.col("v").alias("x"))
    b = mean.select(F.col(key).alias("b"), "pos", F.col("v").alias("y"))
    dots = a.join(b, "pos").where("a <> b").groupBy("a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("dot"))
    na, nb = norm.select(F.col(key).alias("a"), F.col("n").alias("na")), norm.select(F.col(key).alias("b"), F.col("n").alias("nb"))
    return dots.join(na, "a").join(nb, "b").select("a", "b", F.when(F.col("na") * F.col("nb") > 1e-12, F.col("dot") / (F.col("na") * F.col("nb"))).alias("cosine"))
