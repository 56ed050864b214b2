"""Parsed documents to flat notes: patterns, reuse, chords, vibrato and seconds resolved. Joins by document, functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.pitch import chord_root, parse_pitch
from . import timebase

STREAM = ["doc_id", "stream_pos", "stream"]
#: The order of a stream's notes: explicit events, then each binding's, bar by bar.
ORDER = ["o_binding", "o_bar", "o_pos"]


def _kind() -> Column:
    return F.split("stream", "\\.")[0]


def _track() -> Column:
    return F.when(F.contains("stream", F.lit(".")), F.regexp_replace("stream", "^[^.]*\\.", "")).otherwise(F.lit(""))


def key_values(text: Column, value) -> Column:
    """`a 21ms, s 0.68` to a map; parts that aren't two words or whose value() is null go, the last of equal keys holds."""
    parts = F.transform(F.split(text, ","), lambda p: F.split(F.trim(F.regexp_replace(p, "\\s+", " ")), " "))
    pairs = F.filter(F.transform(F.filter(parts, lambda w: F.size(w) == 2), lambda w: F.struct(w[0].alias("key"), value(w[1]).alias("value"))), lambda x: x["value"].isNotNull())
    last = F.filter(pairs, lambda x, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda y: y["key"] == x["key"]))
    return F.map_from_entries(last)


def envelope(text: Column) -> Column:
    """Times in seconds (`21ms`, `2s`), plain numbers as they are."""
    return key_values(text, lambda v: F.when(v.endswith("ms"), F.regexp_replace(v, "ms$", "").try_cast("double") / 1000).otherwise(F.regexp_replace(v, "s$", "").try_cast("double")))


def vibrato(text: Column) -> Column:
    return key_values(text, lambda v: F.regexp_replace(v, "±|Hz|c|s", "").try_cast("double"))


def chord_map(rows: DataFrame) -> DataFrame:
    """(doc_id, bar, symbol): the first harmony stream's chords; a reuse reads what was bound so far, so reuses chain."""
    here = F.col("stream") == "harmony"
    told = rows.where(here).groupBy("doc_id").agg(
        F.min("stream_pos").alias("_first"), F.sort_array(F.collect_list(F.when(F.col("kind") == "binding", F.struct("stream_pos", "pos", "binding.first", "binding.last", "binding.like_first", "binding.like_last", "binding.chords")))).alias("_b")
    )

    def bind(acc: Column, b: Column) -> Column:
        bars = F.when(b["last"] >= b["first"], F.sequence(b["first"], b["last"])).otherwise(F.array().cast("array<int>"))
        source = lambda i: b["like_first"] + i % (b["like_last"] - b["like_first"] + 1)
        symbol = lambda i: F.when(b["chords"].isNotNull(), F.get(b["chords"], i % F.size(b["chords"]))).otherwise(F.coalesce(F.try_element_at(acc, source(i)), F.lit("")))
        new = F.map_from_arrays(bars, F.transform(bars, lambda x, i: symbol(i)))
        bound = b["chords"].isNotNull() | (b["like_last"] >= b["like_first"])
        return F.when(bound, F.map_concat(F.map_filter(acc, lambda k, v: ~k.between(b["first"], b["last"])), new)).otherwise(acc)

    own = F.filter("_b", lambda b: b["stream_pos"] == F.col("_first"))
    folded = F.aggregate(own, F.map_from_arrays(F.array().cast("array<int>"), F.array().cast("array<string>")), bind)
    return told.select("doc_id", F.explode(folded).alias("bar", "symbol"))


def stream_events(rows: DataFrame) -> DataFrame:
    """Explicit events of notes and perc streams, and what their bindings make: (STREAM, ORDER, bar, beat, seconds, event).

    A pattern's event takes the bar it is bound to unless it names its own; the last definition of a pattern holds. A
    reuse (`like`) copies the explicit events of the source bars only, repeated to fill the target, and shifts known
    velocities within 1 to 127; its repeat count and transposition have no effect. Bindings of unknown patterns do nothing.
    """
    mine = rows.where(_kind().isin("notes", "perc"))
    e = F.col("event")
    explicit = mine.where("kind = 'event'").select(*STREAM, F.lit(-1).alias("o_binding"), F.lit(0).alias("o_bar"), F.col("pos").alias("o_pos"), e["bar"].alias("bar"), e["beat"].alias("beat"), e["seconds"].alias("seconds"), "event")

    bound = mine.where("kind = 'binding'").select(*STREAM, F.col("pos").alias("o_binding"), "binding.*").where("last >= first")
    pattern = mine.where("kind = 'pattern'")
    latest = pattern.groupBy("doc_id", "stream_pos", "name").agg(F.max("line").alias("line"))
    pattern = pattern.join(latest, ["doc_id", "stream_pos", "name", "line"]).select("doc_id", "stream_pos", F.col("name").alias("pattern"), F.col("pos").alias("o_pos"), "event")
    made = bound.where("pattern is not null").join(pattern, ["doc_id", "stream_pos", "pattern"]).withColumn("at", F.explode(F.sequence("first", "last")))
    made = made.select(*STREAM, "o_binding", (F.col("at") - F.col("first")).alias("o_bar"), "o_pos", F.coalesce(e["bar"], F.col("at")).alias("bar"), e["beat"].alias("beat"), F.when(e["bar"].isNotNull(), e["seconds"]).alias("seconds"), "event")

    reuse = bound.where("like_last >= like_first").withColumn("i", F.explode(F.sequence(F.lit(0), F.col("last") - F.col("first"))))
    reuse = reuse.select("doc_id", "stream_pos", "o_binding", F.col("i").alias("o_bar"), (F.col("first") + F.col("i")).alias("at"), F.col("vel").alias("shift"), (F.col("like_first") + F.col("i") % (F.col("like_last") - F.col("like_first") + 1)).alias("bar"))
    vel = F.when(F.coalesce(F.col("shift"), F.lit(0)) != 0, F.greatest(F.lit(1), F.least(F.lit(127), e["vel"] + F.col("shift")))).otherwise(e["vel"])
    copied = reuse.join(explicit.drop("o_binding", "o_bar"), ["doc_id", "stream_pos", "bar"]).select(
        *STREAM, "o_binding", "o_bar", "o_pos", F.col("at").alias("bar"), "beat", F.lit(None).cast("double").alias("seconds"), F.when(e["vel"].isNull(), e).otherwise(e.withField("vel", vel)).alias("event")
    )
    return explicit.unionByName(made).unionByName(copied)


def _start() -> Column:
    return F.when(F.col("seconds").isNotNull(), F.col("seconds")).otherwise(timebase.time_of(F.col("_i")))


def expand(rows: DataFrame) -> DataFrame:
    """Notes of parsed documents: (doc_id, start, dur, cents, voice, vel, stream, inst, env, vib, wrong, stream_pos, ORDER).

    Seconds come from the document's grid, deviations included. Lengths: none is 0.25 s, beats of an event in absolute
    seconds are 0.5 s each, the least is 0.02 s. `.` is the root of the bar's chord, and goes where there is none. A
    velocity not told is 90. A pitch that can't be read gives a note without cents that says so in `wrong`. Vibrato is taken from contour streams of the same track at the same millisecond. Sorted by
    (start, stream_pos, ORDER) a document's notes stand in its own order; the frame itself is not sorted. Documents in
    which a line did not parse have notes for the lines before it.
    """
    grid = timebase.grids(rows)
    e = F.col("event")
    vib = rows.where((_kind() == "contour") & (F.col("kind") == "event") & F.map_contains_key("event.blocks", F.lit("vib")))
    vib = vib.select("doc_id", "stream_pos", "pos", _track().alias("track"), e["bar"].alias("bar"), e["beat"].alias("beat"), e["seconds"].alias("seconds"), e["blocks"]["vib"].alias("text"))
    vib = vib.join(grid, "doc_id").withColumn("_i", timebase.beat_index(F.col("bar"), F.col("beat"))).select("doc_id", "track", F.bround(_start(), 3).alias("at"), "stream_pos", "pos", "text")
    vib = vib.groupBy("doc_id", "track", "at").agg(F.max_by("text", F.struct("stream_pos", "pos")).alias("_vib"))
    inst = rows.where("kind = 'field' and name = 'inst'").groupBy("doc_id", "stream_pos").agg(F.max_by(F.col("args")[0], "pos").alias("inst"))

    found = stream_events(rows).where(e["atom"].isNotNull()).join(grid, "doc_id").withColumn("_i", timebase.beat_index(F.col("bar"), F.col("beat")))
    amount = F.regexp_replace(e["dur"], "[bs]$", "").try_cast("double")
    length = (
        F.when(e["dur"].isNull(), 0.25).when(e["dur"].endswith("s"), amount).when(F.col("seconds").isNotNull(), amount * 0.5).otherwise(timebase.time_of(F.col("_i") + amount) - F.col("_at"))
    )
    timed = found.withColumn("_at", _start()).withColumn("dur", F.greatest(F.lit(0.02), length)).drop("tempo", "meters", "anchors")
    one = F.coalesce(F.nullif(F.col("bar"), F.lit(0)), F.lit(1))
    keyed = timed.withColumn("bar", one).withColumn("track", _track()).withColumn("at", F.bround("_at", 3))
    chords = chord_map(rows).withColumn("root", chord_root(F.col("symbol"))).drop("symbol")
    whole = keyed.join(chords, ["doc_id", "bar"], "left").join(vib, ["doc_id", "track", "at"], "left").join(inst, ["doc_id", "stream_pos"], "left")
    perc, root = _kind() == "perc", e["atom"] == "."
    return whole.where(perc | ~root | F.col("root").isNotNull()).select(
        "doc_id", (F.col("_at") + e["dev"] / 1000).alias("start"), "dur", F.when(perc, F.lit(None)).when(root, F.col("root")).otherwise(parse_pitch(e["atom"])).alias("cents"), F.when(perc, e["atom"]).alias("voice"),
        F.coalesce(e["vel"], F.lit(90)).alias("vel"), "stream", F.coalesce("inst", F.lit("unknown")).alias("inst"), envelope(e["blocks"]["env"]).alias("env"), vibrato(F.col("_vib")).alias("vib"), F.when(~perc & ~root & parse_pitch(e["atom"]).isNull(), F.concat(F.lit("not a pitch: "), e["atom"])).alias("wrong"), "stream_pos", *ORDER,
    )
