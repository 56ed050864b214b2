"""The time base of documents: bars and beats to seconds by a tempo curve, meters and anchors. DataFrame functions only.

A document's grid is one row of arrays; a position is looked up in closed form, so neither bars nor beats are enumerated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def _last(a: Column) -> Column:
    return F.get(a, F.size(a) - 1)


def _seconds(c: Column) -> Column:
    return F.regexp_replace(c, "^@+", "").try_cast("double")


def _or(a: Column, default: Column) -> Column:
    return F.when(F.size(a) > 0, a).otherwise(F.array(default))


def _beats_at(tempo: Column, t: Column) -> Column:
    """Beats from the curve's first point to t: trapezoids, flat outside the curve."""

    def between(p: Column, n: Column) -> Column:
        bpm = F.when(n.isNull(), p["bpm"]).otherwise(p["bpm"] + F.try_divide((n["bpm"] - p["bpm"]) * (t - p["t"]), n["t"] - p["t"]))
        return F.when(p.isNull(), (t - tempo[0]["t"]) * tempo[0]["bpm"] / 60).otherwise(p["cum"] + (t - p["t"]) * (p["bpm"] + bpm) / 120)

    return _let(F.struct(_last(F.filter(tempo, lambda p: p["t"] <= t)).alias("p"), F.get(F.filter(tempo, lambda p: p["t"] > t), 0).alias("n")), lambda s: between(s["p"], s["n"]))


def _time_at(tempo: Column, beats: Column) -> Column:
    """The inverse of _beats_at: a quadratic on a sloped segment."""

    def solve(p: Column, n: Column) -> Column:
        x = (beats - p["cum"]) * 60
        a = F.try_divide(n["bpm"] - p["bpm"], 2 * (n["t"] - p["t"]))
        flat = p["t"] + F.try_divide(x, p["bpm"])
        sloped = p["t"] + F.try_divide(F.sqrt(p["bpm"] * p["bpm"] + 4 * a * x) - p["bpm"], 2 * a)
        before = tempo[0]["t"] + F.try_divide(beats * 60, tempo[0]["bpm"])
        return F.when(p.isNull(), before).when(n.isNull() | (F.abs(n["bpm"] - p["bpm"]) < 1e-9), flat).otherwise(sloped)

    return _let(F.struct(_last(F.filter(tempo, lambda p: p["cum"] <= beats)).alias("p"), F.get(F.filter(tempo, lambda p: p["cum"] > beats), 0).alias("n")), lambda s: solve(s["p"], s["n"]))


def grids(rows: DataFrame) -> DataFrame:
    """(doc_id, tempo, meters, anchors): a row for every document of parsed rows.

    Statements come from the first stream named grid. Without tempo the document has 120 beats a minute, without meter
    4/4, without anchor bar 1 at 0 s. A beat is a quarter note. The meter of a bar is chosen by the bar's time under
    the first tempo and first meter alone. Of tempo points at the same time the last one holds. Statements that aren't
    numbers are left out.
    """
    grid = F.col("stream") == "grid"
    told = rows.groupBy("doc_id").agg(
        F.min(F.when(grid, F.col("stream_pos"))).alias("_first"),
        F.sort_array(F.collect_list(F.when(grid & (F.col("kind") == "statement"), F.struct("stream_pos", "pos", "name", "args")))).alias("_said"),
    )
    said = lambda name, least: F.filter("_said", lambda x: (x["stream_pos"] == F.col("_first")) & (x["name"] == name) & (F.size(x["args"]) >= least))
    part = lambda x, i: F.split(x["args"][1], "/")[i].try_cast("int")
    points = F.transform(said("tempo", 2), lambda x: F.struct(_seconds(x["args"][0]).alias("t"), x["pos"].alias("pos"), x["args"][1].try_cast("double").alias("bpm")))
    meters = F.transform(F.filter(said("meter", 2), lambda x: x["args"][1].rlike("^[0-9]+/[0-9]+$")), lambda x: F.struct(_seconds(x["args"][0]).alias("t"), x["pos"].alias("pos"), part(x, 0).alias("num"), part(x, 1).alias("den")))
    anchors = F.transform(said("anchor", 3), lambda x: F.struct(x["args"][1].try_cast("int").alias("bar"), x["pos"].alias("pos"), _seconds(x["args"][2]).alias("t")))
    sound = lambda a, *names: F.sort_array(F.filter(a, lambda x: F.forall(F.array(*(x[n].isNotNull() for n in names)), lambda ok: ok)))
    zero = lambda *cols: F.struct(*(F.lit(v).cast(t).alias(n) for n, t, v in cols))
    out = told.select(
        "doc_id",
        _or(sound(points, "t", "bpm"), zero(("t", "double", 0), ("pos", "int", 0), ("bpm", "double", 120))).alias("tempo"),
        _or(sound(meters, "t", "num", "den"), zero(("t", "double", 0), ("pos", "int", 0), ("num", "int", 4), ("den", "int", 4))).alias("meters"),
        _or(sound(anchors, "bar", "t"), zero(("bar", "int", 1), ("pos", "int", 0), ("t", "double", 0))).alias("anchors"),
    )
    rough = lambda b: F.col("anchors")[0]["t"] + (b - F.col("anchors")[0]["bar"]) * F.col("meters")[0]["num"] * (60 / F.col("tempo")[0]["bpm"])
    guess = lambda t: F.col("anchors")[0]["bar"] + F.ceil((t - F.col("anchors")[0]["t"]) / (F.col("meters")[0]["num"] * (60 / F.col("tempo")[0]["bpm"])))
    first_bar = lambda m: _let(guess(m["t"]), lambda g: F.array_min(F.filter(F.array(g - 1, g, g + 1), lambda b: m["t"] <= rough(b))))
    spans = F.transform("meters", lambda m, i: F.struct(F.when(i == 0, F.lit(1)).otherwise(F.greatest(F.lit(1), first_bar(m))).cast("long").alias("first"), (m["num"] * 4.0 / m["den"]).alias("beats")))
    out = out.withColumn("meters", spans)
    kept = F.filter("tempo", lambda p, i: F.coalesce(F.get("tempo", i + 1)["t"] != p["t"], F.lit(True)))
    curve = F.aggregate(
        kept,
        F.array().cast("array<struct<t:double,bpm:double,cum:double>>"),
        lambda a, p: F.concat(a, F.array(F.struct(p["t"].alias("t"), p["bpm"].alias("bpm"), F.coalesce(_last(a)["cum"] + (p["t"] - _last(a)["t"]) * (p["bpm"] + _last(a)["bpm"]) / 120, F.lit(0.0)).alias("cum")))),
    )
    out = out.withColumn("tempo", curve)
    at = F.transform("anchors", lambda a: F.struct(a["bar"].alias("bar"), a["t"].alias("t"), _bar_start(a["bar"]).alias("idx"), _beats_at(F.col("tempo"), a["t"]).alias("cum")))
    out = out.withColumn("anchors", at)

    def scale(a: Column, n: Column) -> Column:
        took = _time_at(F.col("tempo"), a["cum"] + n["idx"] - a["idx"]) - a["t"]
        return F.when(n.isNotNull() & (took > 0), F.try_divide(n["t"] - a["t"], took))

    scaled = F.transform("anchors", lambda a, i: F.struct(a["bar"].alias("bar"), a["t"].alias("t"), a["idx"].alias("idx"), a["cum"].alias("cum"), scale(a, F.get("anchors", i + 1)).alias("scale")))
    return out.withColumn("anchors", scaled)


def _bar_start(bar: Column) -> Column:
    """Beats before a bar, from bar 1 on; a sum over the grid's meters."""
    ends = lambda i: F.coalesce(F.least(bar.cast("long"), F.get("meters", i + 1)["first"]), bar.cast("long"))
    each = F.transform("meters", lambda m, i: m["beats"] * F.greatest(F.lit(0).cast("long"), ends(i) - m["first"]))
    return F.aggregate(each, F.lit(0.0), lambda a, x: a + x)


def beat_index(bar: Column, beat: Column) -> Column:
    """Beats from bar 1 beat 1 to bar:beat, beside a row's grid. A null or 0 counts as 1."""
    one = lambda c: F.coalesce(F.nullif(c, F.lit(0)), F.lit(1))
    return _bar_start(one(bar)) + (one(beat) - 1.0)


def time_of(index: Column) -> Column:
    """Seconds of a beat index, beside a row's grid: the curve's shape, scaled to land on the next anchor.

    Before the first anchor it is that anchor's time; after the last one the curve is used as it is.
    """

    def along(a: Column) -> Column:
        want = index - a["idx"]
        return F.when(a.isNull(), F.col("anchors")[0]["t"]).when(want <= 0, a["t"]).otherwise(a["t"] + (_time_at(F.col("tempo"), a["cum"] + want) - a["t"]) * F.coalesce(a["scale"], F.lit(1.0)))

    return _let(_last(F.filter("anchors", lambda a: a["idx"] <= index)), along)


def bar_starts(rows: DataFrame, bars: int) -> DataFrame:
    """(doc_id, bar, start): the first `bars` bars of every document."""
    each = grids(rows).withColumn("bar", F.explode(F.sequence(F.lit(1), F.lit(bars))))
    return each.withColumn("_i", beat_index(F.col("bar"), F.lit(1.0))).select("doc_id", "bar", time_of(F.col("_i")).alias("start"))
