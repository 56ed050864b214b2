"""Songs: missing time, the blend with the mix, lags, calibration samples, history lines, change reports and tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import delta, minutes
from .scoring import AXES

#: Metrics that calibration never measures (fixed values): all of the mix, and the sung words of the vocals.
MANUAL_PARTS, MANUAL = ["mix"], [("vocal", "sung_wer"), ("vocal", "sung_wer_original"), ("vocal", "sung_wer_excess")]
#: The keys of an anchor that come first in its file (fixed values).
ANCHOR_KEYS = ["floor", "ceiling", "weight", "axis"]


def missing_share(slices: DataFrame, by: list[str]) -> DataFrame:
    """(by, missing_share): of slices (by, state, a, b) the time that is missing over the time that the original sounds."""
    span = F.col("b") - F.col("a")
    gone, there = F.sum(F.when(F.col("state") == "missing", span)), F.sum(F.when(F.col("state") != "silent", span))
    return slices.groupBy(*by).agg(F.coalesce(F.coalesce(gone, F.lit(0.0)) / F.nullif(there, F.lit(0.0)), F.lit(0.0)).alias("missing_share"))


def penalised(parts: DataFrame, share: DataFrame, by: list[str]) -> DataFrame:
    """Parts (by, what, sound, dyn, score) with axes and score times 1 - missing_share; score_present keeps what is there."""
    out = parts.join(share, by, "left").withColumn("missing_share", F.coalesce("missing_share", F.lit(0.0))).withColumn("score_present", F.col("score"))
    for c in (*AXES, "score"):
        out = out.withColumn(c, F.col(c) * (1 - F.col("missing_share")))
    return out


def song_scores(parts: DataFrame, mix: DataFrame, by: list[str]) -> DataFrame:
    """(by, parts_score, mix_score, score): parts (by, silent, missing, score, energy) weighted by energy, half and half with
    the mix (by, silent, score). Silent parts go with their weight; a missing part, or one without a score, counts as 0 with
    its weight. Without weight only the mix counts, without a mix (or with a silent one) only the parts; null without both."""
    heard = F.when(~F.col("silent"), F.col("energy"))
    worth = F.when(F.col("missing"), 0.0).otherwise(F.coalesce("score", F.lit(0.0)))
    told = parts.groupBy(*by).agg((F.sum(heard * worth) / F.nullif(F.sum(heard), F.lit(0.0))).alias("parts_score"))
    both = told.join(mix.select(*by, F.when(~F.col("silent"), F.col("score")).alias("mix_score")), by, "full_outer")
    return both.withColumn("score", F.coalesce((F.col("parts_score") + F.col("mix_score")) / 2, F.col("parts_score"), F.col("mix_score")))


def song_lag(windows: DataFrame, by: list[str], lag: str = "lag_ms", state: str = "state") -> DataFrame:
    """(by, lag_ms_abs_median): the median |lag| of the windows that are ok and have one."""
    return windows.groupBy(*by).agg(F.median(F.when(F.col(state) == "ok", F.abs(F.col(lag)))).alias("lag_ms_abs_median"))


def lag_series(windows: DataFrame, by: list[str], part: str, limit: float = 30.0) -> tuple[DataFrame, DataFrame]:
    """(by, part, mid, lag_ms) of the parts with any lag, and (by, drifting): the sorted parts with a window beyond the limit."""
    some = F.count("lag_ms").over(Window.partitionBy(*by, part)) > 0
    series = windows.withColumn("_some", some).where("_some").select(*by, part, ((F.col("a") + F.col("b")) / 2).alias("mid"), "lag_ms")
    return series, windows.where(F.abs(F.col("lag_ms")) > limit).groupBy(*by).agg(F.array_join(F.sort_array(F.collect_set(part)), ",").alias("drifting"))


def measured(samples: DataFrame) -> DataFrame:
    """Calibration samples (part_type, metric, ...) without those that are set by hand."""
    by_hand = samples.sparkSession.createDataFrame(MANUAL, "part_type string, metric string")
    return samples.where(~F.col("part_type").isin(MANUAL_PARTS)).join(F.broadcast(by_hand), ["part_type", "metric"], "left_anti")


def pooled(samples: DataFrame) -> DataFrame:
    """(part_type, metric, value) of samples (part_type, metric, value as text, active): numbers only, of active sides only.
    Truth values, texts and what isn't finite are no numbers."""
    v = F.when(~F.lower(F.trim("value")).isin("true", "false"), F.col("value").try_cast("double"))
    return samples.where("active").select("part_type", "metric", v.alias("value")).where(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") != float("inf")))


def section_key(label: Column, a: Column) -> Column:
    """`label@m:ss`, so that sections of one label stay apart."""
    return F.concat(label, F.lit("@"), minutes(a))


def history_parts(slices: DataFrame, parts: DataFrame, by: list[str]) -> DataFrame:
    """The history's line of every part: (by, score, what, sound, dyn, sections: label@m:ss to score)."""
    mine = slices.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(section_key(F.col("label"), F.col("a")).alias("key"), "score"))).alias("_s"))
    return parts.join(mine, by, "left").select(*by, "score", *AXES, F.map_from_entries(F.coalesce("_s", F.array().cast("array<struct<key:string,score:double>>"))).alias("sections"))


def number(x: Column) -> Column:
    """A whole number, half to even; a dash for none."""
    return F.coalesce(F.rint(x).cast("long").cast("string"), F.lit("—"))


def change(before: Column, after: Column) -> Column:
    """`52 → 61 (+9)` of two scores, `37 → —` if one is missing."""
    both = before.isNotNull() & after.isNotNull()
    plain = F.concat(number(before), F.lit(" → "), number(after))
    return F.when(both, F.concat(plain, F.lit(" "), delta(after - before))).otherwise(plain)


def changes(before: DataFrame, after: DataFrame, by: list[str]) -> DataFrame:
    """(by, before, after, verdict) of rows (by, score) of two runs with a score in one of them: improved by 5 or more,
    regressed by 5 or more, same, or none where one score is missing."""
    both = after.select(*by, F.col("score").alias("after")).join(before.select(*by, F.col("score").alias("before")), by).where("before is not null or after is not null")
    d = F.col("after") - F.col("before")
    return both.select(*by, "before", "after", F.when(d >= 5, "improved").when(d <= -5, "regressed").when(d.isNotNull(), "same").otherwise("none").alias("verdict"))


def report_lines(told: DataFrame, by: str, song: str, part: str) -> DataFrame:
    """(by, pos, line): the Markdown table of a run's parts (by, song, part, what, sound, dyn, score, before), and behind it
    the changes, the greatest first. pos orders the lines of a `by`."""
    row = F.concat(F.lit("| "), F.col(song), F.lit(" | "), F.col(part), F.lit(" | "), number(F.col("what")), F.lit(" | "), number(F.col("sound")), F.lit(" | "), number(F.col("dyn")), F.lit(" | "), number(F.col("score")), F.lit(" | "), F.when(F.col("before").isNotNull() & F.col("score").isNotNull(), delta(F.col("score") - F.col("before"))).otherwise(""), F.lit(" |"))
    rows = told.select(by, F.lit(2).alias("block"), F.lit(0.0).alias("key"), F.col(song).alias("s"), F.col(part).alias("p"), row.alias("line"))
    tiers = told.select(by).distinct()
    heads = [(0, F.concat(F.lit("## Tier "), F.col(by))), (1, F.lit("| song | part | what | sound | dyn | score | change |")), (3, F.lit("### Improved (≥ +5)")), (5, F.lit("### Regressed (≤ −5)"))]
    for block, line in heads:
        rows = rows.union(tiers.select(by, F.lit(block), F.lit(0.0), F.lit(""), F.lit(""), line))
    d = F.col("score") - F.col("before")
    for block, hit, way in ((4, d >= 5, -d), (6, d <= -5, d)):
        rows = rows.union(told.where(hit).select(by, F.lit(block), way, F.col(song), F.col(part), F.concat(F.lit("- "), F.col(song), F.lit(" "), F.col(part), F.lit(": "), change(F.col("before"), F.col("score")))))
        none = tiers.join(told.where(hit).select(by).distinct(), by, "left_anti")
        rows = rows.union(none.select(by, F.lit(block), F.lit(0.0), F.lit(""), F.lit(""), F.lit("_none_")))
    return rows.select(by, F.row_number().over(Window.partitionBy(by).orderBy("block", "key", "s", "p")).cast("long").alias("pos"), "line")


def part_order(parts: DataFrame, by: list[str], part: str, silent: str, score: str) -> DataFrame:
    """Adds rank: parts by rising score, those without one as 0, silent ones last, ties by name."""
    w = Window.partitionBy(*by).orderBy(F.col(silent), F.when(F.col(silent), 0.0).otherwise(F.coalesce(score, F.lit(0.0))), part)
    return parts.withColumn("rank", F.row_number().over(w).cast("long"))


def anchor_lines(anchors: DataFrame, extra: list[str]) -> DataFrame:
    """(pos, line): the anchors' file, sorted, a compact line a metric: floor, ceiling, weight and axis first, then the other
    keys that are set. It is a small fixed table, so one window numbers its lines."""
    cell = lambda c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f'"{c}": '), F.concat(F.lit('"'), F.col(c), F.lit('"')) if dict(anchors.dtypes)[c] == "string" else F.col(c).cast("string")))
    body = F.concat(F.lit('    "'), F.col("metric"), F.lit('": {'), F.concat_ws(", ", *(cell(c) for c in (*ANCHOR_KEYS, *extra))), F.lit("}"))
    t, m = Window.partitionBy("part_type").orderBy("metric"), Window.orderBy("part_type")
    lines = anchors.select("part_type", F.lit(1).alias("block"), "metric", F.concat(body, F.when(F.lead("metric").over(t).isNotNull(), ",").otherwise("")).alias("line"))
    types = anchors.select("part_type").distinct().withColumn("_more", F.lead("part_type").over(m).isNotNull())
    lines = lines.union(types.select("part_type", F.lit(0), F.lit(""), F.concat(F.lit('  "'), F.col("part_type"), F.lit('": {'))))
    lines = lines.union(types.select("part_type", F.lit(2), F.lit(""), F.when(F.col("_more"), "  },").otherwise("  }")))
    lines = lines.union(anchors.sparkSession.createDataFrame([("", -1, "", "{"), ("\U0010ffff", 3, "", "}")], lines.schema))
    return lines.select(F.row_number().over(Window.orderBy("part_type", "block", "metric")).cast("long").alias("pos"), "line")


def word_error(matched: DataFrame, by: list[str], ref: str, est: str, a: Column, b: Column) -> DataFrame:
    """(by, mae): the median |start difference| of matched words whose original start lies in [a, b); null for none."""
    inside = (F.col(ref) >= a) & (F.col(ref) < b)
    return matched.groupBy(*by).agg(F.median(F.when(inside, F.abs(F.col(est) - F.col(ref)))).alias("mae"))


def headroom(peak: Column, most: float = 0.8) -> Column:
    """The gain that brings a peak down to `most`, 1 for lower ones; outputs are divided by it."""
    return F.when(peak > most, most / peak).otherwise(1.0)


def vocal_stream(streams: DataFrame, by: list[str], inst: str, stem: str, name: str, order: str) -> DataFrame:
    """The stream that is sung: the first whose instrument is a lead voice, else whose stem is the lead vocals, else that is
    named vox; keys without one go."""
    rank = F.when(F.col(inst).startswith("voice.lead"), 0).when(F.col(stem) == "lead_vocals", 1).when(F.col(name).isin("vox", "notes.vox"), 2)
    first = F.row_number().over(Window.partitionBy(*by).orderBy("_rank", order))
    return streams.withColumn("_rank", rank).where("_rank is not null").withColumn("_n", first).where("_n = 1").drop("_rank", "_n")


def candidates(found: DataFrame, wanted: DataFrame, by: list[str], length: str, order: str) -> DataFrame:
    """Of the found records with lyrics the one whose length is nearest to the wanted one (by, duration), the first of equal
    ones; without a wanted length the first."""
    far = F.abs(F.coalesce(F.col(length), F.lit(0.0)) - F.col("duration"))
    n = F.row_number().over(Window.partitionBy(*by).orderBy(far.asc_nulls_first(), order))
    return found.where("lyrics is not null and lyrics <> ''").join(wanted, by).withColumn("_n", n).where("_n = 1").drop("_n")


def last_line(lines: DataFrame, by: list[str], pos: str, text: str) -> DataFrame:
    """(by, line): the last line of a log that says something: no INFO lines, no progress."""
    kept = ~F.contains(F.col(text), F.lit(" - INFO - ")) & ~F.contains(F.col(text), F.lit("it/s]")) & (F.trim(text) != "")
    return lines.where(kept).groupBy(*by).agg(F.max_by(text, pos).alias("line"))
