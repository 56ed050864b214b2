"""The parts of a document or a recording: declared sections, bar windows, boundaries by novelty, downbeats, prompts, keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import timebase
from .joins import sweep

#: How well the twelve semitones fit a major and a minor key (fixed values, Krumhansl and Kessler).
MAJOR = [6.35, 2.23, 3.48, 2.33, 4.38, 4.09, 2.52, 5.19, 2.39, 3.66, 2.29, 2.88]
MINOR = [6.33, 2.68, 3.52, 5.38, 2.60, 3.53, 2.54, 4.75, 3.98, 2.69, 3.34, 3.17]


def declared_sections(rows: DataFrame) -> DataFrame:
    """(doc_id, pos, label, lo, hi) of the statements `label lo-hi` of the first struct stream; others are left out. pos counts
    by first bar, ties by place."""
    mine = rows.where("stream = 'struct' and kind = 'statement'").withColumn("_first", F.min("stream_pos").over(Window.partitionBy("doc_id"))).where("stream_pos = _first")
    bars = F.regexp_extract(F.col("args")[0], "^(-?[0-9]+)-(-?[0-9]+)$", 1).try_cast("int"), F.regexp_extract(F.col("args")[0], "^(-?[0-9]+)-(-?[0-9]+)$", 2).try_cast("int")
    told = mine.where(F.size("args") > 0).select("doc_id", F.col("pos").alias("_pos"), F.col("name").alias("label"), bars[0].alias("lo"), bars[1].alias("hi")).where("lo is not null and hi is not null")
    return told.withColumn("pos", F.row_number().over(Window.partitionBy("doc_id").orderBy("lo", "_pos")) - 1).drop("_pos")


def sections(rows: DataFrame, durations: DataFrame, bars: int = 8) -> DataFrame:
    """(doc_id, pos, label, a, b) in seconds, for documents in durations (doc_id, duration).

    With two labels or more the declared sections, each up to the bar behind its last one, the next section's start or the
    duration, whichever is first; what no section covers stays uncovered, empty ones go. Else windows of `bars` bars up to
    the duration. Bars are placed by the document's grid.
    """
    told = declared_sections(rows)
    many = told.groupBy("doc_id").agg((F.count_distinct("label") >= 2).alias("_many"))
    grid = timebase.grids(rows).join(durations, "doc_id")
    at = lambda bar: timebase.time_of(timebase.beat_index(bar, F.lit(1.0)))
    nxt = F.lead("lo").over(Window.partitionBy("doc_id").orderBy("pos"))
    own = told.withColumn("nxt", nxt).join(many.where("_many"), "doc_id").join(grid, "doc_id")
    own = own.withColumn("a", at(F.col("lo"))).withColumn("b", F.least(at(F.col("hi") + 1), F.when(F.col("nxt").isNotNull(), at(F.col("nxt"))), F.col("duration")))
    rest = grid.join(many, "doc_id", "left").where(~F.coalesce("_many", F.lit(False)))
    # as many windows as the fastest tempo could need; those that begin behind the duration go
    fastest = F.array_max(F.transform("tempo", lambda p: p["bpm"]))
    rest = rest.withColumn("pos", F.explode(F.sequence(F.lit(0), F.ceil(F.col("duration") * F.greatest(fastest, F.lit(1.0)) / 60 / bars).cast("int") + F.lit(1))))
    lo = F.col("pos") * bars + 1
    rest = rest.withColumn("a", at(lo)).withColumn("b", F.least(at(lo + bars), F.col("duration"))).withColumn("label", F.concat(F.lit("bars "), lo.cast("string"), F.lit("-"), (lo + bars - 1).cast("string")))
    cols = ["doc_id", F.col("pos").cast("long").alias("pos"), "label", "a", "b"]
    return own.select(*cols).union(rest.select(*cols)).where("b > a")


def section_energy(frames: DataFrame, by: list[str], segment: str, value: str) -> DataFrame:
    """(by, segment, energy): a segment's mean as a share of the greatest value of its key; 0 where that is 0."""
    means = frames.groupBy(*by, segment).agg(F.avg(value).alias("_m"), F.max(value).alias("_x"))
    peak = F.max("_x").over(Window.partitionBy(*by))
    return means.withColumn("energy", F.coalesce(F.col("_m") / F.nullif(peak, F.lit(0.0)), F.lit(0.0))).drop("_m", "_x")


def key_estimate(chroma: DataFrame, by: list[str], pc: str, value: str) -> DataFrame:
    """(by, root, mode, r): the key whose profile, turned to its root, correlates best with the twelve sums of a key; of equal
    ones the lower root, major first. A flat or incomplete chroma has none."""
    spark = chroma.sparkSession
    turned = [(root, mode, (i + root) % 12, float(p[i])) for root in range(12) for mode, p in (("major", MAJOR), ("minor", MINOR)) for i in range(12)]
    profiles = F.broadcast(spark.createDataFrame(turned, "root long, mode string, _pc long, _p double"))
    sums = chroma.groupBy(*by, F.col(pc).cast("long").alias("_pc")).agg(F.sum(value).cast("double").alias("_v"))
    x, p = F.col("_v"), F.col("_p")
    flat = F.nullif(F.stddev_pop(x) * F.stddev_pop(p), F.lit(0.0))
    fits = sums.join(profiles, "_pc").groupBy(*by, "root", "mode").agg((F.covar_pop(x, p) / flat).alias("r"), F.count("*").alias("_n")).where("_n = 12 and r is not null")
    best = F.max(F.struct(F.round("r", 12).alias("x"), (-F.col("root")).alias("root"), (F.col("mode") == "major").alias("major"), "r")).alias("b")
    return fits.groupBy(*by).agg(best).select(*by, (-F.col("b.root")).alias("root"), F.when(F.col("b.major"), "major").otherwise("minor").alias("mode"), F.col("b.r").alias("r"))


def downbeat_phase(beats: DataFrame, by: list[str], pos: str, flux: str, per_bar: int = 4) -> DataFrame:
    """(by, phase, mean): of the first beats of a key the one whose every per_bar-th beat has the greatest mean flux; the
    earlier one of equal ones."""
    means = beats.groupBy(*by, F.pmod(F.col(pos), F.lit(per_bar)).alias("phase")).agg(F.avg(flux).alias("mean"))
    return means.groupBy(*by).agg(F.max(F.struct("mean", (-F.col("phase")).alias("at"))).alias("b")).select(*by, (-F.col("b.at")).alias("phase"), F.col("b.mean").alias("mean"))


def novelty(bars: DataFrame, by: list[str], bar: str, vector: str, energy: str) -> DataFrame:
    """(by, bar, novelty): how far the means of the two bars before a boundary lie from those of the two behind it: squared
    distance of the vectors, plus four times that of the energies as shares of the key's peak. Boundaries with two bars on
    both sides only."""
    w = Window.partitionBy(*by).orderBy(bar)
    at = lambda c, k: F.lag(c, k).over(w) if k > 0 else F.lead(c, -k).over(w) if k < 0 else F.col(c)
    mean = lambda a, b: F.zip_with(a, b, lambda x, y: (x + y) / 2)
    sides = bars.select(*by, F.col(bar), mean(at(vector, 2), at(vector, 1)).alias("_l"), mean(at(vector, 0), at(vector, -1)).alias("_r"), ((at(energy, 2) + at(energy, 1)) / 2 - (at(energy, 0) + at(energy, -1)) / 2).alias("_d"), F.max(energy).over(Window.partitionBy(*by)).alias("_peak"))
    apart = F.aggregate(F.zip_with("_l", "_r", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda a, x: a + x)
    share = F.col("_d") / F.coalesce(F.nullif("_peak", F.lit(0.0)), F.lit(1.0))
    return sides.where("_d is not null").select(*by, bar, (apart + 4 * share * share).alias("novelty"))


def boundaries(scored: DataFrame, by: list[str], bar: str, score: str, most: int, apart: int = 4) -> DataFrame:
    """The `most` strongest boundaries of a key that are `apart` bars from each other, stronger ones first, earlier ones of
    equal ones. A pass by falling score that holds the boundaries taken."""

    def step(state: dict, row: dict, out: list) -> None:
        taken = state.setdefault("taken", [])
        if len(taken) < most and all(abs(row[bar] - x) >= apart for x in taken):
            taken.append(row[bar])
            out.append((*(row[k] for k in by), row[bar], row[score]))

    df = scored.select(*by, bar, score, (-F.col(score)).alias("_down"))
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in (*by, bar, score))
    return sweep(df, by, ["_down", bar], schema, step, lambda key, state, out: None)


def prompt_window(notes: DataFrame, by: list[str], start: str, end: str, want: float = 8.0) -> DataFrame:
    """(by, t0, t1): a span to read a voice from: from a little before the first note to the middle of the first rest of 0.2
    that begins after 0.6 of `want`, else `want` long; never longer than 12 or 1.25 times `want`."""
    w = Window.partitionBy(*by).orderBy(start, end)
    each = notes.withColumn("_next", F.lead(start).over(w)).withColumn("_t0", F.greatest(F.lit(0.0), F.min(start).over(Window.partitionBy(*by)) - 0.2))
    fits = (F.col(end) >= F.col("_t0") + 0.6 * want) & (F.col("_next") - F.col(end) >= 0.2)
    cut = F.min_by(F.when(fits, (F.col(end) + F.col("_next")) / 2), F.when(fits, F.col(start)))
    told = each.groupBy(*by).agg(F.min("_t0").alias("t0"), cut.alias("_cut"))
    return told.select(*by, "t0", F.least(F.coalesce("_cut", F.col("t0") + want), F.col("t0") + max(12.0, 1.25 * want)).alias("t1"))
