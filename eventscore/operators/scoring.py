"""Anchored 0-100 scores, axes, parts, songs, states and calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Weights of the axes in a part's geometric mean (fixed values).
AXES = {"what": 0.4, "sound": 0.4, "dyn": 0.2}


def anchored(value: Column, floor: Column, ceiling: Column, cap: Column | None = None) -> Column:
    """Where a value lies between floor (0) and ceiling (100), cut at both; a floor above the ceiling: lower is better,
    and then a cap holds the floor down."""
    low = floor if cap is None else F.when((floor > ceiling) & cap.isNotNull(), F.least(floor, cap)).otherwise(floor)
    return 100 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), (value - low) / F.nullif(ceiling - low, F.lit(0.0))))


def score_metrics(metrics: DataFrame, anchors: DataFrame) -> DataFrame:
    """Long metrics (metric, raw, ...) with `score`; unknown metrics go. Anchors are a small fixed table."""
    joined = metrics.join(anchors, "metric")
    cap = F.col("floor_cap") if "floor_cap" in anchors.columns else None
    return joined.withColumn("score", F.when(F.col("raw").isNotNull(), anchored(F.col("raw"), F.col("floor"), F.col("ceiling"), cap)))


def axis_mean(score: Column, weight: Column, axis: Column, name: str) -> Column:
    """Weighted arithmetic mean of an axis' known scores."""
    on = (axis == name) & score.isNotNull()
    return F.sum(F.when(on, score * weight)) / F.nullif(F.sum(F.when(on, weight)), F.lit(0.0))


def geometric(axes: dict[str, Column], weights: dict[str, float] = AXES) -> Column:
    """Weighted geometric mean of the known axes, each at least 1."""
    logs = [F.when(c.isNotNull(), F.lit(weights[k]) * F.ln(F.greatest(c, F.lit(1.0)))).otherwise(0.0) for k, c in axes.items()]
    known = [F.when(c.isNotNull(), F.lit(weights[k])).otherwise(0.0) for k, c in axes.items()]
    return F.exp(sum(logs[1:], logs[0]) / F.nullif(sum(known[1:], known[0]), F.lit(0.0)))


def roll_up(scored: DataFrame, by: list[str]) -> DataFrame:
    """(by, what, sound, dyn, score) of scored long metrics."""
    axes = scored.groupBy(*by).agg(*(axis_mean(F.col("score"), F.col("weight"), F.col("axis"), k).alias(k) for k in AXES))
    return axes.withColumn("score", geometric({k: F.col(k) for k in AXES}))


def state(ref_active: Column, est_active: Column) -> Column:
    """silent (the original is), missing (only the copy is), ok."""
    return F.when(~ref_active, "silent").when(~est_active, "missing").otherwise("ok")


def weighted_score(score: Column, energy: Column) -> Column:
    """Energy-weighted mean; a part without a score counts as 0 with its weight."""
    return F.sum(F.coalesce(score, F.lit(0.0)) * energy) / F.nullif(F.sum(energy), F.lit(0.0))
