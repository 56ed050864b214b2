"""Queries of groups F to K: scoring, roll-up, calibration, history, text alignment, documents, streaming, folds."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import pitch
from ..operators import align, folds, joins, measures, scoring, series
from ..streaming.windows import streamed_counts
from .base import events, query, r4, table
from .events_queries import HOURLY_SQL, H, hourly

#: Our own anchors: metric, floor, ceiling, weight, axis, floor_cap.
ANCHORS = [("value_cents", 3000.0, 0.0, 3.0, "what", 2500.0), ("onset_density_ratio", 0.3, 1.0, 1.0, "what", None), ("env_corr", -0.3, 0.6, 1.0, "sound", None), ("level_diff_db_abs", 14.0, 0.0, 1.0, "dyn", None)]
ANCHOR_SQL = "anchors(metric, floor, ceiling, weight, axis, floor_cap) as (values " + ", ".join("(" + ", ".join("null" if x is None else f"'{x}'" if isinstance(x, str) else f"{x}::double" for x in r) + ")" for r in ANCHORS) + ")"


def anchors(spark: SparkSession) -> DataFrame:
    return F.broadcast(spark.createDataFrame(ANCHORS, "metric string, floor double, ceiling double, weight double, axis string, floor_cap double"))


def frames(spark: SparkSession, d: str) -> DataFrame:
    """(song, part, frame, r, e, nr, ne, mr, me): 60 frames of 6 h a side, sums, counts and means; missing frames are 0."""
    x = events(spark, d).where("t < 2592000").withColumn("song", F.col("user_id") % 10).withColumn("ref", F.col("t") < 1296000).withColumn("frame", F.floor(F.col("t") / 21600) % 60)
    v = lambda ref, f: f(F.when(F.col("ref") == ref, F.col("value")))
    got = x.groupBy("song", F.col("event_type").alias("part"), "frame").agg(v(True, F.sum).alias("r"), v(False, F.sum).alias("e"), v(True, F.count).alias("nr"), v(False, F.count).alias("ne"), v(True, F.avg).alias("mr"), v(False, F.avg).alias("me"))
    grid = x.select("song", F.col("event_type").alias("part")).distinct().withColumn("frame", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(59).cast("long"))))
    return grid.join(got, ["song", "part", "frame"], "left").na.fill(0, ["nr", "ne"]).na.fill(0.0, ["r", "e"])


FRAMES_SQL = """x as (select user_id % 10 as song, event_type as part, t < 1296000 as ref, cast(floor(t / 21600) as bigint) % 60 as frame, value from ev where t < 2592000),
 got as (select song, part, frame, sum(value) filter (where ref) as r, sum(value) filter (where not ref) as e, count(*) filter (where ref) as nr, count(*) filter (where not ref) as ne, avg(value) filter (where ref) as mr, avg(value) filter (where not ref) as me from x group by 1, 2, 3),
 frames as (select song, part, frame, coalesce(r, 0) as r, coalesce(e, 0) as e, coalesce(nr, 0) as nr, coalesce(ne, 0) as ne, mr, me from (select distinct song, part from x) cross join (select unnest(range(60)) as frame) left join got using (song, part, frame))"""


def raw_metrics(f: DataFrame, by: list[str]) -> DataFrame:
    """Long metrics (by, metric, raw) of frames grouped by `by`."""
    db = F.abs(measures.level_db(F.col("e")) - measures.level_db(F.col("r")))
    n, m = F.sum("nr"), F.sum("ne")
    wide = f.groupBy(*by).agg(db.alias("level_diff_db_abs"), measures.pearson(F.col("r"), F.col("e")).alias("env_corr"), (F.least(n, m) / F.nullif(F.greatest(n, m), F.lit(0))).alias("onset_density_ratio"), measures.median_cents(F.col("mr"), F.col("me")).alias("value_cents"))
    return wide.unpivot(by, ["level_diff_db_abs", "env_corr", "onset_density_ratio", "value_cents"], "metric", "raw")


def raw_sql(by: str, source: str = "frames") -> str:
    return f"""wide as (select {by}, abs(20 * log10(nullif(sqrt(avg(e * e)), 0)) - 20 * log10(nullif(sqrt(avg(r * r)), 0))) as level_diff_db_abs, covar_pop(r, e) / nullif(stddev_pop(r) * stddev_pop(e), 0) as env_corr,
 least(sum(nr), sum(ne)) / nullif(greatest(sum(nr), sum(ne)), 0) as onset_density_ratio, case when count(*) filter (where mr > 0 and me > 0) >= 10 then median(case when mr > 0 and me > 0 then abs(1200 * log2(me / mr)) end) end as value_cents from {source} group by all),
 metrics as (select {by}, 'level_diff_db_abs' as metric, level_diff_db_abs::double as raw from wide union all select {by}, 'env_corr', env_corr from wide union all select {by}, 'onset_density_ratio', onset_density_ratio::double from wide union all select {by}, 'value_cents', value_cents from wide),
 {ANCHOR_SQL}, low as (select m.*, a.* exclude (metric, floor), case when floor > ceiling and floor_cap is not null then least(floor, floor_cap) else floor end as lo from metrics m join anchors a using (metric)),
 scored as (select *, case when raw is not null then 100 * greatest(0, least(1, (raw - lo) / nullif(ceiling - lo, 0))) end as score from low),
 axes as (select {by}, sum(score * weight) filter (where axis = 'what') / sum(weight) filter (where axis = 'what' and score is not null) as what, sum(score * weight) filter (where axis = 'sound') / sum(weight) filter (where axis = 'sound' and score is not null) as sound,
 sum(score * weight) filter (where axis = 'dyn') / sum(weight) filter (where axis = 'dyn' and score is not null) as dyn from scored group by all),
 parts as (select *, exp((coalesce(0.4 * ln(greatest(what, 1)), 0) + coalesce(0.4 * ln(greatest(sound, 1)), 0) + coalesce(0.2 * ln(greatest(dyn, 1)), 0)) / nullif((case when what is null then 0 else 0.4 end) + (case when sound is null then 0 else 0.4 end) + (case when dyn is null then 0 else 0.2 end), 0)) as score from axes)"""


@query("with {ev}, " + FRAMES_SQL + ", " + raw_sql("song, part") + " select song, part, metric, round(raw, 4) as raw, round(score, 4) as score from scored")
def sco1_anchor_score(spark: SparkSession, d: str) -> DataFrame:
    return scoring.score_metrics(raw_metrics(frames(spark, d), ["song", "part"]), anchors(spark)).select("song", "part", "metric", r4(F.col("raw"), "raw"), r4(F.col("score"), "score"))


SLICED_SQL = "sliced as (select w.pos, f.* from frames f join (select unnest(range(5)) as pos) w on f.frame >= w.pos * 10 and f.frame < w.pos * 10 + 20)"


def sliced(f: DataFrame) -> DataFrame:
    """Frames in 5 windows of 20 frames every 10."""
    return series.in_windows(f, "frame", 20, 10, 60).drop("a", "b")


@query("with {ev}, " + FRAMES_SQL + ", " + SLICED_SQL + ", " + raw_sql("song, part, pos", "sliced") + " select song, part, pos, round(what, 4) as what, round(sound, 4) as sound, round(dyn, 4) as dyn, round(score, 4) as score from parts")
def sco2_slice_axes(spark: SparkSession, d: str) -> DataFrame:
    s = scoring.roll_up(scoring.score_metrics(raw_metrics(sliced(frames(spark, d)), ["song", "part", "pos"]), anchors(spark)), ["song", "part", "pos"])
    return s.select("song", "part", "pos", *(r4(F.col(c), c) for c in ("what", "sound", "dyn", "score")))


STATE_SQL = "act as (select song, part, pos, avg(case when r >= 1500 then 1.0 else 0.0 end) >= 0.1 as ref, avg(case when e >= 1500 then 1.0 else 0.0 end) >= 0.1 as est from sliced group by all), st as (select *, case when not ref then 'silent' when not est then 'missing' else 'ok' end as state from act)"


@query("with {ev}, " + FRAMES_SQL + ", " + SLICED_SQL + ", " + STATE_SQL + ", " + raw_sql("song, part, pos", "sliced") + """, j as (select song, part, pos, state, case state when 'silent' then null when 'missing' then 0 else score end as s from parts join st using (song, part, pos))
 select song, part, count(*) filter (where state = 'silent') as silent, count(*) filter (where state = 'missing') as missing, round(min(s), 4) as worst, round(avg(s) filter (where state = 'ok'), 4) as score_present, round(avg(s) filter (where state = 'ok') * (1 - count(*) filter (where state = 'missing') * 1.0 / nullif(count(*) filter (where state <> 'silent'), 0)), 4) as score from j group by 1, 2""")
def sco3_part_states(spark: SparkSession, d: str) -> DataFrame:
    f = sliced(frames(spark, d))
    key = ["song", "part", "pos"]
    loud = lambda c: F.avg(F.when(F.col(c) >= 1500, 1.0).otherwise(0.0)) >= 0.1
    st = f.groupBy(*key).agg(loud("r").alias("ref"), loud("e").alias("est")).withColumn("state", scoring.state(F.col("ref"), F.col("est")))
    s = scoring.roll_up(scoring.score_metrics(raw_metrics(f, key), anchors(spark)), key)
    j = s.join(st, key).withColumn("s", F.when(F.col("state") == "ok", F.col("score")).when(F.col("state") == "missing", 0.0))
    ok, gone = F.avg(F.when(F.col("state") == "ok", F.col("s"))), F.count_if(F.col("state") == "missing")
    return j.groupBy("song", "part").agg(F.count_if(F.col("state") == "silent").alias("silent"), gone.alias("missing"), r4(F.min("s"), "worst"), r4(ok, "score_present"), r4(ok * (1 - gone / F.nullif(F.count_if(F.col("state") != "silent"), F.lit(0))), "score"))


@query("with {ev}, " + FRAMES_SQL + ", " + raw_sql("song, part") + """, en as (select song, part, sum(r * r) / sum(sum(r * r)) over (partition by song) as energy from frames group by 1, 2)
 select song, part, round(what, 4) as what, round(sound, 4) as sound, round(dyn, 4) as dyn, round(score, 4) as part_score, round(energy, 4) as energy, round(sum(coalesce(score, 0) * energy) over (partition by song) / sum(energy) over (partition by song), 4) as song_score from parts join en using (song, part)""")
def agg7_song_score(spark: SparkSession, d: str) -> DataFrame:
    """Flagship: two halves of a month of events compared part by part, scored, and rolled up to songs."""
    f = frames(spark, d)
    s = scoring.roll_up(scoring.score_metrics(raw_metrics(f, ["song", "part"]), anchors(spark)), ["song", "part"])
    j = s.join(measures.energy_share(f, ["song"], "part", "r"), ["song", "part"])
    w = Window.partitionBy("song")
    song = F.sum(F.coalesce("score", F.lit(0.0)) * F.col("energy")).over(w) / F.nullif(F.sum("energy").over(w), F.lit(0.0))
    return j.select("song", "part", r4(F.col("what"), "what"), r4(F.col("sound"), "sound"), r4(F.col("dyn"), "dyn"), r4(F.col("score"), "part_score"), r4(F.col("energy"), "energy"), r4(song, "song_score"))


@query("with {ev}, " + FRAMES_SQL + """, s as (select song, part, frame // 10 as sec, 10 * log10(sum(e * e) / nullif(sum(r * r), 0)) as diff from frames group by all having sum(e * e) > 0 and sum(r * r) > 0), g as (select song, part, 10 * log10(sum(e * e) / sum(r * r)) as diff from frames group by all)
 select song, part, round(avg(abs(s.diff - g.diff)), 4) as arc from s join g using (song, part) group by 1, 2""")
def sco11_dynamic_arc(spark: SparkSession, d: str) -> DataFrame:
    f = frames(spark, d)
    r, e = F.sum(F.col("r") * F.col("r")), F.sum(F.col("e") * F.col("e"))
    diff = F.when((r > 0) & (e > 0), 10 * F.log10(e / F.nullif(r, F.lit(0.0)))).alias("diff")
    s = f.groupBy("song", "part", F.floor(F.col("frame") / 10).alias("sec")).agg(diff)
    g = f.groupBy("song", "part").agg(diff).withColumnRenamed("diff", "whole")
    return s.join(g, ["song", "part"]).groupBy("song", "part").agg(r4(F.avg(F.abs(F.col("diff") - F.col("whole"))), "arc"))


@query("with {ev}, " + FRAMES_SQL + ", " + raw_sql("song, part") + """, m as (select metric, median(raw) filter (where song < 5) as lo, median(raw) filter (where song >= 5) as hi, count(raw) as n from metrics group by 1)
 select metric, n, round(lo, 4) as floor_new, round(hi, 4) as ceiling_new, case when n = 0 or lo is null or hi is null then 'no data' when (hi - lo) * (ceiling - floor) < 0 then 'direction' when abs(hi - lo) < 0.1 * abs(ceiling - least(floor, coalesce(floor_cap, floor))) then 'spread' else 'update' end as verdict from m join anchors using (metric)""")
def cal1_anchors(spark: SparkSession, d: str) -> DataFrame:
    m = raw_metrics(frames(spark, d), ["song", "part"]).groupBy("metric").agg(F.median(F.when(F.col("song") < 5, F.col("raw"))).alias("lo"), F.median(F.when(F.col("song") >= 5, F.col("raw"))).alias("hi"), F.count("raw").alias("n"))
    old = F.abs(F.col("ceiling") - F.least(F.col("floor"), F.coalesce("floor_cap", F.col("floor"))))
    move = F.col("hi") - F.col("lo")
    verdict = F.when((F.col("n") == 0) | F.col("lo").isNull() | F.col("hi").isNull(), "no data").when(move * (F.col("ceiling") - F.col("floor")) < 0, "direction").when(F.abs(move) < 0.1 * old, "spread").otherwise("update")
    return m.join(anchors(spark), "metric").select("metric", "n", r4(F.col("lo"), "floor_new"), r4(F.col("hi"), "ceiling_new"), verdict.alias("verdict"))


@query("""with m as (select l_returnflag || l_linestatus as part, extract(year from l_shipdate) as seq, avg(l_extendedprice) / 500 as score from lineitem group by 1, 2), x as (select part, seq, score, score - lag(score) over (partition by part order by seq) as diff from m)
 select part, cast(seq as bigint) as seq, round(score, 4) as score, round(diff, 4) as diff, case when diff >= 0.5 then 'improved' when diff <= -0.5 then 'regressed' else 'same' end as verdict from x where diff is not null""")
def his3_changes(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "lineitem").groupBy(F.concat("l_returnflag", "l_linestatus").alias("part"), F.year("l_shipdate").cast("long").alias("seq")).agg((F.avg("l_extendedprice") / 500).alias("score"))
    x = m.withColumn("diff", F.col("score") - F.lag("score").over(Window.partitionBy("part").orderBy("seq"))).where("diff is not null")
    return x.select("part", "seq", r4(F.col("score"), "score"), r4(F.col("diff"), "diff"), F.when(F.col("diff") >= 0.5, "improved").when(F.col("diff") <= -0.5, "regressed").otherwise("same").alias("verdict"))


@query("with {ev}, " + FRAMES_SQL + ", " + SLICED_SQL + ", " + raw_sql("song, part, pos", "sliced") + ", k as (select song, part, pos, score, row_number() over (partition by song order by score, part, pos) as rank from parts where score is not null) select song, rank, part, pos, round(score, 4) as score from k where rank <= 3")
def srt1_ranked(spark: SparkSession, d: str) -> DataFrame:
    key = ["song", "part", "pos"]
    s = scoring.roll_up(scoring.score_metrics(raw_metrics(sliced(frames(spark, d)), key), anchors(spark)), key).where("score is not null")
    return series.top_k(s, ["song"], [F.col("score"), F.col("part"), F.col("pos")], 3).select("song", F.col("rank").cast("long").alias("rank"), "part", "pos", r4(F.col("score"), "score"))


@query("with {ev}, " + FRAMES_SQL + ", " + SLICED_SQL + ", " + raw_sql("song, part, pos", "sliced") + " select metric, song, part, pos, round(pos * 60.0 + 60, 4)::double as mid, round(raw, 4) as raw, greatest(0, least(pos * 60 + 60 - 45, 360 - 90))::double as clip_from from metrics where raw is not null")
def rpt3_series(spark: SparkSession, d: str) -> DataFrame:
    m = raw_metrics(sliced(frames(spark, d)), ["song", "part", "pos"]).where("raw is not null")
    mid = (F.col("pos") * 60 + 60).cast("double")
    return m.select("metric", "song", "part", "pos", mid.alias("mid"), r4(F.col("raw"), "raw"), F.greatest(F.lit(0.0), F.least(mid - 45, F.lit(270.0))).alias("clip_from"))


@query("""with u as (select user_id, event_type as inst, event_id as pos from events where event_type in ('click', 'view') union all select user_id, 'ah', event_id from events where event_type = 'error'), m as (select user_id, inst, count(*) as notes, min(pos) as first from u group by 1, 2) select user_id, inst, notes, first, edge from m join (select distinct user_id, cast(floor(value / 100) as bigint) as edge from events) using (user_id)""")
def set2_fillers(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    u = e.where("event_type in ('click', 'view')").select("user_id", F.col("event_type").alias("inst"), F.col("event_id").alias("pos")).unionByName(e.where("event_type = 'error'").select("user_id", F.lit("ah").alias("inst"), F.col("event_id").alias("pos")))
    edges = e.select("user_id", F.floor(F.col("value") / 100).alias("edge")).distinct()
    return u.groupBy("user_id", "inst").agg(F.count("*").alias("notes"), F.min("pos").alias("first")).join(edges, "user_id")


@query()
def agg16_wer(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, d, "conversations").withColumn("ref", F.lag("text").over(w)).where("ref is not null")
    return c.select("conv_id", "turn", r4(align.wer(align.tokens(F.col("ref")), align.tokens(F.col("text"))), "wer"))


@query()
def jon15_align(spark: SparkSession, d: str) -> DataFrame:
    """Documents that begin with the same three words, each with the one before: matching blocks of whole texts."""
    t = table(spark, d, "documents").withColumn("w", align.tokens(F.col("text")))
    w = Window.partitionBy(F.array_join(F.slice("w", 1, 3), " ")).orderBy("doc_id")
    p = t.withColumn("prev", F.lag("doc_id").over(w)).withColumn("pw", F.lag("w").over(w)).where("prev is not null")
    return p.select("doc_id", "prev", align.similarity(F.col("pw"), F.col("w")).alias("m")).select("doc_id", "prev", "m.matched", "m.longest", r4(F.col("m.ratio"), "ratio"))


@query("""with c as (select conv_id, turn, role, text, len(string_split(text, ' ')) as words, avg(len(string_split(text, ' '))) over (partition by conv_id) as mean, max(turn) over (partition by conv_id) as last from conversations)
 select conv_id, turn, role from c where not (role = 'assistant' and words < 0.5 * mean) and turn < last - 0.05 and text not in ('Thank you.', 'Thanks for watching!')""")
def flt10_before_end(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("conv_id")
    n = F.size(F.split("text", " "))
    c = table(spark, d, "conversations").withColumn("words", n).withColumn("mean", F.avg("words").over(w)).withColumn("last", F.max("turn").over(w))
    return c.where(~((F.col("role") == "assistant") & (F.col("words") < 0.5 * F.col("mean"))) & (F.col("turn") < F.col("last") - 0.05) & ~F.col("text").isin("Thank you.", "Thanks for watching!")).select("conv_id", "turn", "role")


@query()
def srt7_best_offset(spark: SparkSession, d: str) -> DataFrame:
    """Each benchmark passage's best place among the documents: places that share any four words in a row with it, all places for passages under eight words."""
    b = table(spark, d, "benchmark").select("item_id", align.tokens(F.col("text")).alias("bw")).withColumn("m", F.size("bw")).where("m > 0")
    t = table(spark, d, "documents").select("doc_id", align.tokens(F.col("text")).alias("w")).withColumn("n", F.size("w"))
    windows = lambda w, n: F.posexplode(F.transform(F.sequence(F.lit(1), n - 3), lambda i: F.xxhash64(F.slice(w, i, 4)))).alias("at", "k")
    seeds = b.where("m >= 8").select("item_id", windows("bw", F.col("m"))).withColumnRenamed("at", "i")
    places = t.where("n >= 4").select("doc_id", windows("w", F.col("n"))).join(F.broadcast(seeds), "k")
    seeded = places.select("item_id", "doc_id", F.greatest(F.col("at") - F.col("i") + 1, F.lit(1)).alias("off")).distinct()
    scan = t.where("n > 0").select("doc_id", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("off")).crossJoin(F.broadcast(b.where("m < 8").select("item_id")))
    hits = seeded.unionByName(scan).join(F.broadcast(b), "item_id").join(t, "doc_id")
    part = F.slice("w", F.col("off"), F.col("m"))
    r = hits.select("item_id", "doc_id", F.col("off").cast("long").alias("off"), align.similarity(F.col("bw"), part).alias("m")).select("item_id", "doc_id", "off", F.col("m.ratio").alias("ratio")).where("ratio >= 0.5")
    return series.top_k(r, ["item_id"], [F.desc("ratio"), F.col("doc_id"), F.col("off")], 1).select("item_id", "doc_id", "off", r4(F.col("ratio"), "ratio"))


@query()
def reconcile(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark passages with every fifth word dropped, reconciled with the whole: each word with its time."""
    b = table(spark, d, "benchmark").select("item_id", align.tokens(F.col("text")).alias("ref"))
    heard = F.filter("ref", lambda w, i: i % 5 != 4)
    times = F.filter(F.transform("ref", lambda w, i: F.when(i % 5 != 4, i * 0.5)), lambda x: x.isNotNull())
    return b.select("item_id", F.explode(align.reconcile(F.col("ref"), heard, times)).alias("x")).select("item_id", F.col("x.i").cast("long").alias("i"), "x.word", "x.heard", r4(F.col("x.at"), "at"))


@query("select cast(floor(epoch(ts) / 21600) * 21600 as bigint) as a, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def stream_windows(spark: SparkSession, d: str) -> DataFrame:
    """Window counts by a stream over events."""
    return streamed_counts(spark, f"{d}/events.parquet").withColumn("a", F.unix_timestamp("a"))


@query("""with s as (select unnest(range(12)) as k, unnest(['C','C#','D','D#','E','F','F#','G','G#','A','A#','B']) as symbol) select symbol, cast((k + 12 * ceil((28 - k) / 12.0)) * 100 as double) as root, cast((5 * 12 + k) * 100 as double) as cents from s""")
def scl1_note_names(spark: SparkSession, d: str) -> DataFrame:
    s = spark.createDataFrame([(x,) for x in pitch.SHARPS], "symbol string")
    return s.select("symbol", pitch.chord_root(F.col("symbol")).alias("root"), pitch.name_to_cents(F.concat("symbol", F.lit("4"))).alias("cents"))


@query("""with m as (select user_id, max(value) as peak from events group by 1) select event_id, round(20 * log10(value), 4) as db, cast(round_even(greatest(1, least(127, 20 + 107 * sqrt(value / peak))), 0) as bigint) as vel, case when value / peak >= 0.8 then '' else '?' || cast(cast(floor(value / peak * 100 + 0.5) as bigint) as varchar) end as mark from events join m using (user_id)""")
def scl20_marks(spark: SparkSession, d: str) -> DataFrame:
    v, peak, inf, nan = F.col("value"), F.col("peak"), float("inf"), float("nan")
    x = events(spark, d).where("user_id is not null").withColumn("peak", F.max("value").over(Window.partitionBy("user_id")))
    # as IEEE has it: the logarithm of nothing, and shares of a peak that is nothing
    x = x.withColumn("q", F.when(peak != 0, v / peak).when(v < 0, -inf).when(v == 0, nan))
    db = F.when(v > 0, 20 * F.log10("value")).when(v == 0, -inf).when(v < 0, nan)
    return x.select("event_id", r4(db, "db"), F.rint(F.greatest(F.lit(1.0), F.least(F.lit(127.0), 20 + 107 * F.sqrt("q")))).cast("long").alias("vel"), F.when(F.col("q") >= 0.8, "").otherwise(F.concat(F.lit("?"), F.floor(F.col("q") * 100 + 0.5).cast("string"))).alias("mark"))


@query("""with {ev}, x as (select event_id, t + value as t, 0 as o, 'off' as what from ev union all select event_id, t, 1, 'bend' from ev where event_type = 'view' union all select event_id, t, 2, 'on' from ev) select event_id, round(t, 4) as t, what, row_number() over (partition by event_id % 100 order by t, o, event_id) as place, event_id % 100 as track from x""")
def scl22_on_off(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    row = lambda t, o, w: F.struct(t.alias("t"), F.lit(o).alias("o"), F.lit(w).alias("what"))
    parts = F.array(row(F.col("t") + F.col("value"), 0, "off"), F.when(F.col("event_type") == "view", row(F.col("t"), 1, "bend")), row(F.col("t"), 2, "on"))
    x = e.select("event_id", (F.col("event_id") % 100).alias("track"), F.explode(F.filter(parts, lambda p: p.isNotNull())).alias("p")).select("event_id", "track", "p.*")
    return x.select("event_id", r4(F.col("t"), "t"), "what", F.row_number().over(Window.partitionBy("track").orderBy("t", "o", "event_id")).cast("long").alias("place"), "track")


@query("""select p_type, split_part(p_type, ' ', 1) as kind, substr(p_type, length(split_part(p_type, ' ', 1)) + 2) as track, count(*) as n, cast(sum(p_size) * 4 + 44 as bigint) as bytes from part group by 1""")
def scl25_sizes(spark: SparkSession, d: str) -> DataFrame:
    kind = F.substring_index("p_type", " ", 1)
    return table(spark, d, "part").groupBy("p_type").agg(F.count("*").alias("n"), (F.sum("p_size") * 4 + 44).alias("bytes")).select("p_type", kind.alias("kind"), F.expr("substring(p_type, length(substring_index(p_type, ' ', 1)) + 2)").alias("track"), "n", "bytes")


@query("""with w as (select conv_id, turn, unnest(string_split(text, ' ')) as w, unnest(range(len(string_split(text, ' ')))) as pos from conversations), d as (select *, sum(length(w) - length(replace(replace(w, '(', ''), '[', '')) - (length(w) - length(replace(replace(w, ')', ''), ']', '')))) over (partition by conv_id, turn order by pos) as depth from w)
 select conv_id, turn, count(*) as words from d where depth <= 0 and w <> '' group by 1, 2""")
def prs17_depth_filter(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", " ")).alias("pos", "w"))
    x = w.withColumn("depth", F.sum(F.regexp_count("w", F.lit("[(\\[]")) - F.regexp_count("w", F.lit("[)\\]]"))).over(Window.partitionBy("conv_id", "turn").orderBy("pos")))
    return x.where("depth <= 0 and w <> ''").groupBy("conv_id", "turn").agg(F.count("*").alias("words"))


@query("""select o_orderkey, max(l_shipdate) is null or max(l_shipdate) < any_value(o_orderdate) as stale, coalesce(max(l_quantity) > 45, false) as needs_cut from orders left join lineitem on o_orderkey = l_orderkey group by 1""")
def flt12_stale(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("out"), F.max("l_quantity").alias("q"))
    return table(spark, d, "orders").join(li, "o_orderkey", "left").select("o_orderkey", (F.col("out").isNull() | (F.col("out") < F.col("o_orderdate"))).alias("stale"), F.coalesce(F.col("q") > 45, F.lit(False)).alias("needs_cut"))


@query("with {ev}, " + HOURLY_SQL + """, m as (select frame, sum(v) as mix, sum(v) filter (where event_type <> 'error') as parts from f group by 1) select round(20 * log10(sqrt(avg(parts * parts)) / sqrt(avg(mix * mix))), 4) as level_diff, round(20 * log10(sqrt(avg((mix - parts) * (mix - parts))) / sqrt(avg(mix * mix))), 4) as residual, (abs(20 * log10(sqrt(avg(parts * parts)) / sqrt(avg(mix * mix)))) <= 1 and 20 * log10(sqrt(avg((mix - parts) * (mix - parts))) / sqrt(avg(mix * mix))) <= -15) as ok from m""")
def flt16_sum_check(spark: SparkSession, d: str) -> DataFrame:
    m = hourly(spark, d).groupBy("frame").agg(F.sum("v").alias("mix"), F.sum(F.when(F.col("event_type") != "error", F.col("v"))).alias("parts"))
    diff = measures.level_db(F.col("parts")) - measures.level_db(F.col("mix"))
    rest = measures.level_db(F.col("mix") - F.col("parts")) - measures.level_db(F.col("mix"))
    return m.agg(r4(diff, "level_diff"), r4(rest, "residual"), ((F.abs(diff) <= 1) & (rest <= -15)).alias("ok"))


@query("""select c_custkey, exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'F') and exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'O') as both, not exists (select 1 from orders where o_custkey = c_custkey) as none from customer""")
def flt17_semi(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max(F.col("o_orderstatus") == "F").alias("f"), F.max(F.col("o_orderstatus") == "O").alias("o"))
    return table(spark, d, "customer").join(o, "c_custkey", "left").select("c_custkey", F.coalesce(F.col("f") & F.col("o"), F.lit(False)).alias("both"), F.col("f").isNull().alias("none"))


@query("""with {ev}, h as (select event_type, avg(value) filter (where t < 1296000) as r, avg(value) filter (where t >= 1296000) as e, max(greatest(cast(floor(t / 7200) as bigint) + 1, 1)) as bars from ev group by 1) select event_type, round(abs(e / r - 1), 4) as err, bars from h""")
def agg27_ratio_err(spark: SparkSession, d: str) -> DataFrame:
    first = F.col("t") < 1296000
    h = events(spark, d).groupBy("event_type").agg(F.avg(F.when(first, F.col("value"))).alias("r"), F.avg(F.when(~first, F.col("value"))).alias("e"), F.max(F.greatest(F.floor(F.col("t") / 7200) + 1, F.lit(1))).alias("bars"))
    return h.select("event_type", r4(F.abs(F.col("e") / F.nullif("r", F.lit(0.0)) - 1), "err"), "bars")


@query("""with {ev}, x as (select *, abs(value - lag(value) over (partition by user_id order by t, event_id)) >= 60 as s from ev), i as (select *, sum(case when s then 1 else 0 end) over (partition by user_id order by t, event_id rows unbounded preceding) as note from x) select user_id, cast(note as bigint) as note, count(*) as n, round(median(value), 4) as mid, cast(min(floor(t / 7200)) as bigint) as block from i group by 1, 2""")
def win3_blocks(spark: SparkSession, d: str) -> DataFrame:
    step = F.abs(F.col("value") - F.lag("value").over(Window.partitionBy("user_id").orderBy("t", "event_id"))) >= 60
    i = series.islands(events(spark, d).withColumn("step", step), ["user_id"], ["t", "event_id"], F.col("step"), "note")
    return i.groupBy("user_id", "note").agg(F.count("*").alias("n"), r4(F.median("value"), "mid"), F.min(F.floor(F.col("t") / 7200)).alias("block"))


@query()
def win9_fold(spark: SparkSession, d: str) -> DataFrame:
    x = events(spark, d).select("user_id", "event_id", "t", (F.col("t") + F.col("value") * 60).alias("end"), "value")
    mono = folds.monophonic(x, ["user_id"], "t", "end", "value", 500 * 60.0)
    s = folds.segments(mono, ["user_id"], "t", "end", 0.0, 720 * H, 15 * H, 2 * H, H)
    return s.select("user_id", "segment", r4(F.col("a"), "a"), r4(F.col("b"), "b"))


@query("""with {ev} select cast(floor(t / 108000) as bigint) as chunk, count(*) as own, (select count(*) from ev y where y.t >= floor(min(x.t) / 108000) * 108000 - 3600 and y.t < floor(min(x.t) / 108000) * 108000 + 111600) as read from ev x group by 1""")
def win24_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of 30 h with 1 h of context on both sides; a chunk keeps what lies in its own span."""
    c = F.floor(F.col("t") / 108000)
    near = F.array_distinct(F.array(F.floor((F.col("t") - 3600) / 108000), c, F.floor((F.col("t") + 3600) / 108000)))
    x = events(spark, d).withColumn("own", c).withColumn("chunk", F.explode(near))
    return x.groupBy("chunk").agg(F.count_if(F.col("own") == F.col("chunk")).alias("own"), F.count("*").alias("read")).where("own > 0")


@query("with {ev}, " + HOURLY_SQL + """, k as (select event_type, frame, v, max(v) over (partition by event_type order by frame rows between 3 preceding and 3 following) as top, avg(v) over w as m, stddev_pop(v) over w as sd from f window w as (partition by event_type order by frame rows between 10 preceding and 10 following)) select event_type, frame, round(v, 4) as v, cast(frame % 4 as bigint) as phase from k where v = top and v > m + 0.5 * sd""")
def win25_peaks(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("event_type").orderBy("frame")
    k = hourly(spark, d).withColumn("top", F.max("v").over(w.rowsBetween(-3, 3))).withColumn("m", F.avg("v").over(w.rowsBetween(-10, 10))).withColumn("sd", F.stddev_pop("v").over(w.rowsBetween(-10, 10)))
    return k.where("v = top and v > m + 0.5 * sd").select("event_type", "frame", r4(F.col("v"), "v"), (F.col("frame") % 4).alias("phase"))


@query()
def win25_spaced(spark: SparkSession, d: str) -> DataFrame:
    return folds.spaced_peaks(win25_peaks(spark, d).withColumn("frame", F.col("frame").cast("double")), ["event_type"], "frame", "v", 5.0)


@query("""with x as (select n_nationkey, 'notes.' || n_regionkey as name, substr(n_name, 1, 1) as stem from nation), k as (select *, row_number() over (partition by name order by n_nationkey) as k from x), j as (select *, sum(case when k > 1 then 1 else 0 end) over (partition by name, stem order by n_nationkey rows unbounded preceding) as j from k)
 select n_nationkey, case when k = 1 then name when j = 1 then name || '.' || stem else name || '.' || stem || cast(cast(j as bigint) as varchar) end as label from j""")
def set5_unique_names(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select("n_nationkey", F.concat(F.lit("notes."), "n_regionkey").alias("name"), F.substring("n_name", 1, 1).alias("stem"), "n_regionkey")
    return folds.unique_names(n, ["n_regionkey"], "name", "stem", "n_nationkey").select("n_nationkey", F.col("unique").alias("label"))
