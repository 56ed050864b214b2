"""Gates and hits: blocks that are open, slices that sound, isolated and crowded hits, decays, lyric windows, what an ear invents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .measures import level_db


def in_open_blocks(events: DataFrame, blocks: DataFrame, by: list[str], on: str, width: float) -> DataFrame:
    """Events that start in an open block (by, block, open); the last block holds what comes after it. One broadcastable row a
    key bounds the block, so the rest is an equi join."""
    last = blocks.groupBy(*by).agg(F.max("block").alias("_last"))
    placed = events.join(last, by).withColumn("block", F.least(F.floor(F.col(on) / width), F.col("_last"))).drop("_last")
    return placed.join(blocks.where("open").select(*by, "block"), [*by, "block"], "left_semi")


def active(frames: DataFrame, by: list[str], rms: str, *, frame_db: float, share: float, whole_db: float) -> DataFrame:
    """(by, share, active): at least `share` of the frames are at frame_db or louder and all together at whole_db or louder.
    With by a whole file it is the file's activity, with a slice the slice's. Nothing at all is not active."""
    loud = F.avg(F.when(20 * F.log10(F.nullif(F.col(rms), F.lit(0.0))) >= frame_db, 1.0).otherwise(0.0))
    return frames.groupBy(*by).agg(loud.alias("share"), F.coalesce((loud >= share) & (level_db(F.col(rms)) >= whole_db), F.lit(False)).alias("active"))


def active_level(frames: DataFrame, by: list[str], value: str, is_open: str) -> DataFrame:
    """(by, level): the level in dB over what lies in open blocks only; null if none is."""
    return frames.groupBy(*by).agg(level_db(F.when(F.col(is_open), F.col(value))).alias("level"))


def isolated(onsets: DataFrame, by: list[str], on: str, gap: float) -> DataFrame:
    """Onsets that the next one follows after `gap` at least; the last of a key has none and goes."""
    return onsets.withColumn("_next", F.lead(on).over(Window.partitionBy(*by).orderBy(on))).where(F.col("_next") - F.col(on) >= gap).drop("_next")


def uncrowded(hits: DataFrame, by: list[str], micros: str, before: int, after: int) -> DataFrame:
    """Hits with no other one from `before` microseconds before to `after` behind them, those of the same time included."""
    near = F.count("*").over(Window.partitionBy(*by).orderBy(micros).rangeBetween(-before, after))
    return hits.withColumn("_near", near).where("_near = 1").drop("_near")


def hit_decay(onsets: DataFrame, envelope: DataFrame, by: list[str], on: str, value: str, window: float, drop_db: float = 20.0, silent: float | None = 1e-12) -> DataFrame:
    """(by, decay, hits): the median time from a hit's peak to drop_db below it, in the hit's own window (up to the next hit,
    `window` at most); hits that never get there, or whose peak is not above `silent` (None: any peak will do), count nowhere.

    Envelope rows take the last hit at or before them, in one sort of both; a hit's window is then a group of its own.
    """
    hits = onsets.select(*by, F.col(on).alias("_t"), F.lit(None).cast("double").alias("_v"), F.col(on).alias("_hit"))
    both = hits.unionByName(envelope.select(*by, F.col(on).alias("_t"), F.col(value).cast("double").alias("_v"), F.lit(None).cast("double").alias("_hit")))
    w = Window.partitionBy(*by).orderBy("_t", F.col("_hit").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    own = both.withColumn("_of", F.last("_hit", ignorenulls=True).over(w)).where((F.col("_v").isNotNull()) & (F.col("_t") < F.col("_of") + window))
    peaks = own.groupBy(*by, "_of").agg(F.max(F.struct("_v", (-F.col("_t")).alias("_t"))).alias("p")).select(*by, "_of", F.col("p._v").alias("_peak"), (-F.col("p._t")).alias("_at"))
    peaks = peaks if silent is None else peaks.where(F.col("_peak") > silent)
    low = own.join(peaks, [*by, "_of"]).where((F.col("_t") >= F.col("_at")) & (F.col("_v") <= F.col("_peak") * 10 ** (-drop_db / 20)))
    each = low.groupBy(*by, "_of").agg((F.min("_t") - F.first("_at")).alias("_d"))
    return each.groupBy(*by).agg(F.median("_d").alias("decay"), F.count("*").alias("hits"))


def lyric_window(lines: DataFrame, by: list[str], t: str, start: Column, end: Column) -> DataFrame:
    """Lines from a second before start to end if any line of the key has a time (then untimed ones go), else all lines."""
    timed = F.max(F.col(t).isNotNull()).over(Window.partitionBy(*by))
    return lines.withColumn("_timed", timed).where(~F.col("_timed") | F.coalesce(F.col(t).between(start - 1, end), F.lit(False))).drop("_timed")


def heard(segments: DataFrame, words: DataFrame, by: list[str], phrases: list[str], *, silent: float = 0.6, sure: float = 0.5) -> DataFrame:
    """Words (by, segment, word, prob) of segments (by, segment, text, no_speech) that speech was heard in: not those over
    `silent`, and of transcripts that are known inventions only those whose words are all at `sure` or more."""
    least = words.groupBy(*by, "segment").agg(F.min("prob").alias("_least"))
    told = segments.join(least, [*by, "segment"], "left").where((F.col("no_speech") <= silent) & ~(F.lower(F.trim("text")).isin(phrases) & (F.coalesce("_least", F.lit(0.0)) < sure)))
    return words.join(told.select(*by, "segment"), [*by, "segment"], "left_semi")


def with_samples(hits: DataFrame, kit: DataFrame, by: list[str], voice: str, order: list[str]) -> DataFrame:
    """Hits whose voice the kit (voice, n samples) has, each with its sample, taken in turn by time."""
    turn = F.row_number().over(Window.partitionBy(*by, voice).orderBy(*order)) - 1
    return hits.join(kit.select(F.col("voice").alias(voice), "n"), voice).withColumn("sample", F.pmod(turn, F.col("n")).cast("long")).drop("n")


def without_samples(hits: DataFrame, kit: DataFrame, voice: str) -> DataFrame:
    """Hits whose voice the kit lacks."""
    return hits.join(kit.select(F.col("voice").alias(voice)), voice, "left_anti")


def frame_range(a: Column, b: Column, rate: float, n: Column) -> tuple[Column, Column]:
    """The frames [first, last) of a slice at `rate` frames a second, half to even, within 0 and n."""
    return F.greatest(F.rint(a * rate).cast("long"), F.lit(0).cast("long")), F.least(F.rint(b * rate).cast("long"), n)
