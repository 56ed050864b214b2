"""Queries of group I and the file round trips: documents made of the event table, parsed, timed and expanded again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import expand, scoring, timebase
from ..sources import files, sc
from .base import events, query, r4
from .score_queries import FRAMES_SQL, SLICED_SQL, anchors, frames, raw_metrics, raw_sql, sliced

#: A document with every feature of the format: anchors, a ritardando, patterns, reuse, chords, vibrato, notes in seconds.
SAMPLE = """%sc 0.3
# a comment
@title "two
  lines"
@duration 30

:grid
meta src=ours conf=1.00
meter @0.000 4/4
anchor bar 1 @0.000
anchor bar 5 @8.400
tempo @0.000 120.00
tempo @8.000 120.00
tempo @16.000 96.00

:harmony
bars 1-2 Am | F
bars 3-6 like 1-2 x2
bars 7 G

:perc.drums  inst=drums.kit
  timbre{ attack 4ms, gated true }
  ~"dry | tight"
meta warn="a | bar"
%pat beat { 1.0 kick 104 dev+10ms | 2.0 snare 118
  3.0 kick 98 | 4.0 snare 120 }
bars 1-2 beat ~0.96
bars 3 unknown
4:1.0 crash 112

:notes.bass inst=bass.synth
%pat root { 1.0 . 0.5b 108 | 3.0 . 1.0b }
bars 1-7 root
8:1.0 . 1.0b 100

:notes.lead
1:1.0 A3 4.0b 62 | 1:2.5 C4 58 ?0.7 alt=C#4 | @3.0 E4 1.0b | @4.0 G4 0.001s env{ a 21ms, s 0.68, bad }
2:1.0 "la" 1b
bars 5-7 like 1-2 vel -60 transpose 2
!auto gain 1:1.0 0.2 -> 3:1.0 0.9

:contour.lead
1:1.0 vib vib{ rate 5.4Hz, depth ±31c, onset 0.22s }
f0 @0.000 5700 5701 x

:later.kind  odd=yes
@2.5 thing 17
"""


def sample(spark: SparkSession) -> DataFrame:
    return files.staged(sc.parse_documents(spark.createDataFrame([("sample", SAMPLE), ("empty", "")], "doc_id string, text string")), "parsed")


@query()
def sc_parse_golden(spark: SparkSession, d: str) -> DataFrame:
    """Rows of the sample by stream and kind."""
    return sample(spark).groupBy("doc_id", "stream", "kind").agg(F.count("*").alias("n"))


@query()
def sc_expand_golden(spark: SparkSession, d: str) -> DataFrame:
    """The sample's notes."""
    return expand.expand(sample(spark)).drop("env", "vib").withColumn("start", F.round("start", 6)).withColumn("dur", F.round("dur", 6))


#: The grid of users' documents. Events with an even id are told as bar:beat (whole beats), the others in seconds of their day.
BPM, BEATS = 90.0, 3


def user_documents(spark: SparkSession, d: str) -> DataFrame:
    """A document for every user: a grid, and a notes stream with the user's events in order of time."""
    e = events(spark, d).withColumn("doc_id", F.col("user_id").cast("string"))
    users = e.select("doc_id").distinct()
    e = e.withColumn("us", F.pmod(F.col("us"), F.lit(86_400_000_000)))
    beat = F.floor(F.col("us") / 1e6 * (BPM / 60)).cast("long")
    when = F.when(F.col("event_id") % 2 == 0, F.concat((F.floor(beat / BEATS) + 1).cast("string"), F.lit(":"), (F.pmod(beat, F.lit(BEATS)) + 1).cast("string"))).otherwise(F.concat(F.lit("@"), F.format_string("%.3f", F.floor(F.col("us") / 1000) / 1000)))
    dur = F.when(F.col("event_id") % 3 == 0, "").when(F.col("event_id") % 3 == 1, " 0.5b").otherwise(" 0.125s")
    line = F.concat(when, F.lit(" "), (F.floor(F.col("value") * 10)).cast("string"), F.lit("c"), dur, F.lit(" "), (F.col("event_id") % 127 + 1).cast("string"))
    lines = e.select("doc_id", F.lit(1).alias("stream_pos"), F.col("event_id").alias("pos"), line.alias("line"))
    grid = F.array(F.lit("meter @0 3/4"), F.lit(f"tempo @0.000 {BPM}"))
    fixed = users.select("doc_id", F.lit(0).alias("stream_pos"), F.posexplode(grid).alias("pos", "line")).withColumn("pos", F.col("pos").cast("long"))
    none = F.lit(None).cast("string")
    streams = users.select("doc_id", F.lit(0).alias("stream_pos"), F.lit("grid").alias("head"), none.alias("meta"), none.alias("omitted"))
    streams = streams.unionByName(users.select("doc_id", F.lit(1).alias("stream_pos"), F.lit("notes.all inst=events").alias("head"), F.lit("meta src=events conf=1.00").alias("meta"), none.alias("omitted")))
    return files.documents(streams, lines.unionByName(fixed))


NOTES_SQL = f"""day as (select *, us % 86400000000 as u from ev),
 b as (select *, cast(floor(u / 1e6 * {BPM / 60}::double) as bigint) as beat from day),
 notes as (select cast(user_id as varchar) as doc_id, event_id, case when event_id % 2 = 0 then beat * {60 / BPM}::double else floor(u / 1000) / 1000 end as start,
 case when event_id % 3 = 0 then 0.25 when event_id % 3 = 2 then 0.125 when event_id % 2 = 0 then 0.5 * {60 / BPM}::double else 0.25 end as dur, floor(value * 10) as cents, event_id % 127 + 1 as vel from b)"""


@query("with {ev}, " + NOTES_SQL + " select doc_id, count(*) as n, round(sum(start), 3) as starts, round(sum(dur), 4) as durs, sum(cents)::double as cents, sum(vel)::bigint as vels from notes group by doc_id")
def sc_expand(spark: SparkSession, d: str) -> DataFrame:
    """Events written as documents, parsed, timed and expanded: the notes of every user, summed."""
    notes = expand.expand(files.staged(sc.parse_documents(user_documents(spark, d)), "parsed"))
    return notes.groupBy("doc_id").agg(F.count("*").alias("n"), F.round(F.sum("start"), 3).alias("starts"), r4(F.sum("dur"), "durs"), F.sum("cents").alias("cents"), F.sum("vel").cast("long").alias("vels"))


@query(f"with {{ev}} select cast(user_id as varchar) as doc_id, bar::int as bar, round((bar - 1) * {BEATS * 60 / BPM}::double, 4) as start from (select distinct user_id from ev) cross join (select unnest(range(1, 17)) as bar)")
def sc_timebase(spark: SparkSession, d: str) -> DataFrame:
    """The first 16 bars of every user's document."""
    return timebase.bar_starts(files.staged(sc.parse_documents(user_documents(spark, d)), "parsed"), 16).select("doc_id", "bar", r4(F.col("start"), "start"))


@query("with {ev}, g as (select user_id, event_type, count(*) as n, sum(round(value * 100)::bigint) as s from ev group by all) select user_id, event_type, n, s::double / 100 as s, case when n > 2 then floor(s::double * 100 / n)::bigint::double / 10000 end as mean, lpad(cast(user_id as varchar), 8, ' ') || '  ' || rpad(event_type, 10, ' ') || '  ' || lpad(cast(n as varchar), 5, ' ') as line from g")
def io_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """A history written in two appends as JSON lines (no non-finite numbers), read back, replaced at once, and set as a text
    table. Values are summed as whole hundredths and means cut to four digits, so no sum ends on a tie."""
    g = events(spark, d).groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("h"))
    mean = files.finite(F.when(F.col("n") > 2, F.floor(F.col("h").cast("double") * 100 / F.col("n")).cast("double") / 10000).otherwise(float("nan")))
    g = g.select("user_id", "event_type", "n", (F.col("h").cast("double") / 100).alias("s"), mean.alias("mean"))
    at = files.shared_folder(spark, "roundtrip")
    schema = "user_id long, event_type string, n long, s double, mean double"
    for odd in (0, 1):
        files.append_history(g.where(F.col("user_id") % 2 == odd), f"{at}/history")
    files.replace(files.read_history(spark, f"{at}/history", schema), f"{at}/report", ignoreNullFields="false")
    back = files.read_history(spark, f"{at}/report", schema)
    return back.select("user_id", "event_type", "n", "s", "mean", files.fixed_width({"user_id": 8, "event_type": 10, "n": 5}, left=("event_type",)).alias("line"))


@query("with {ev}, " + FRAMES_SQL + ", " + SLICED_SQL + ", " + raw_sql("song, part, pos", "sliced") + " select song, part, count(*) as n_slices, count(score) as n_scored, round(min(score), 4) as worst, round(max(score), 4) as best, round(avg(score), 4) as mean from parts group by song, part")
def sco10_full(spark: SparkSession, d: str) -> DataFrame:
    """All songs scored in full, slice by slice, gathered by part: how many slices have a score, the worst, best and mean."""
    f = sliced(frames(spark, d))
    scored = scoring.roll_up(scoring.score_metrics(raw_metrics(f, ["song", "part", "pos"]), anchors(spark)), ["song", "part", "pos"])
    return scored.groupBy("song", "part").agg(F.count("*").alias("n_slices"), F.count("score").alias("n_scored"), r4(F.min("score"), "worst"), r4(F.max("score"), "best"), r4(F.avg("score"), "mean"))
