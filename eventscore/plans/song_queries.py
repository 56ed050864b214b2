"""Queries of songs and reports: blends, penalties, lags, calibration samples, history lines, changes, tables, logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import delta
from ..operators import measures, scoring, songs
from .base import events, query, r4, table
from .score_queries import ANCHORS, FRAMES_SQL, SLICED_SQL, STATE_SQL, anchors, frames, raw_metrics, raw_sql, sliced

AXES_SELECT = ", ".join(f"round({c}, 4) as {c}" for c in ("what", "sound", "dyn", "score"))


def part_scores(f: DataFrame, by: list[str]) -> DataFrame:
    return scoring.roll_up(scoring.score_metrics(raw_metrics(f, by), anchors(f.sparkSession)), by)


def window_states(f: DataFrame) -> DataFrame:
    """(song, part, pos, state, a, b) of the five windows of every part."""
    loud = lambda c: F.avg(F.when(F.col(c) >= 1500, 1.0).otherwise(0.0)) >= 0.1
    st = sliced(f).groupBy("song", "part", "pos").agg(loud("r").alias("ref"), loud("e").alias("est"))
    return st.select("song", "part", "pos", scoring.state(F.col("ref"), F.col("est")).alias("state"), (F.col("pos") * 10.0).alias("a"), (F.col("pos") * 10.0 + 20).alias("b"))


@query("with {ev}, " + FRAMES_SQL + ", " + SLICED_SQL + ", " + STATE_SQL + ", " + raw_sql("song, part") + """, ms as (select song, part, coalesce(count(*) filter (where state = 'missing') * 1.0 / nullif(count(*) filter (where state <> 'silent'), 0), 0) as m from st group by 1, 2)
 select song, part, round(m, 4)::double as missing_share, round(score, 4) as score_present, round(what * (1 - m), 4) as what, round(sound * (1 - m), 4) as sound, round(dyn * (1 - m), 4) as dyn, round(score * (1 - m), 4) as score from parts join ms using (song, part)""")
def sco5_penalty(spark: SparkSession, d: str) -> DataFrame:
    f = frames(spark, d)
    out = songs.penalised(part_scores(f, ["song", "part"]), songs.missing_share(window_states(f), ["song", "part"]), ["song", "part"])
    return out.select("song", "part", r4(F.col("missing_share"), "missing_share"), *(r4(F.col(c), c) for c in ("score_present", "what", "sound", "dyn", "score")))


@query("with {ev}, " + FRAMES_SQL + ", " + raw_sql("song, part") + """, en as (select song, part, sum(r * r) / sum(sum(r * r)) over (partition by song) as energy from frames group by 1, 2), j as (select *, (song + length(part)) % 5 = 0 as silent, (song * length(part)) % 7 = 0 as missing from parts join en using (song, part)),
 p as (select song, sum(case when missing then 0 else coalesce(score, 0) end * energy) filter (where not silent) / sum(energy) filter (where not silent) as ps from j group by 1), m as (select user_id % 10 as song, case when user_id % 10 % 4 <> 0 then user_id % 10 * 7.0 end as ms from ev where user_id % 10 < 8 group by 1)
 select song, round(ps, 4) as parts_score, ms::double as mix_score, round(coalesce((ps + ms) / 2, ps, ms), 4) as score from p full outer join m using (song)""")
def sco6_mix_blend(spark: SparkSession, d: str) -> DataFrame:
    f = frames(spark, d)
    n = F.length("part")
    parts = part_scores(f, ["song", "part"]).join(measures.energy_share(f, ["song"], "part", "r"), ["song", "part"]).withColumn("silent", (F.col("song") + n) % 5 == 0).withColumn("missing", (F.col("song") * n) % 7 == 0)
    song = F.col("user_id") % 10
    mix = table(spark, d, "events").where(song < 8).select(song.alias("song")).distinct().withColumn("silent", F.col("song") % 4 == 0).withColumn("score", F.col("song") * 7.0)
    return songs.song_scores(parts, mix, ["song"]).select("song", r4(F.col("parts_score"), "parts_score"), "mix_score", r4(F.col("score"), "score"))


@query("select user_id, median(abs((event_id * 37) % 201 - 100)) filter (where event_id % 3 = 0 and event_id % 7 <> 0)::double as lag_ms_abs_median from events group by 1")
def sco7_song_lag(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    w = table(spark, d, "events").withColumn("lag_ms", F.when(e % 7 != 0, ((e * 37) % 201 - 100).cast("double"))).withColumn("state", F.when(e % 3 == 0, "ok").when(e % 3 == 1, "missing").otherwise("silent"))
    return songs.song_lag(w, ["user_id"])


@query("with {ev}, " + FRAMES_SQL + ", " + raw_sql("song, part") + ", act as (select song, part, max(r) >= 1 and max(e) >= 1 as active from frames group by all) select song, part, metric, round(raw, 4) as raw from metrics join act using (song, part) where active and raw is not null")
def sco12_part_metrics(spark: SparkSession, d: str) -> DataFrame:
    """What calibration measures: every part as a whole, without slices, where both sides sound."""
    f = frames(spark, d)
    act = f.groupBy("song", "part").agg(((F.max("r") >= 1) & (F.max("e") >= 1)).alias("active")).where("active").drop("active")
    return raw_metrics(f, ["song", "part"]).join(act, ["song", "part"]).where("raw is not null").select("song", "part", "metric", r4(F.col("raw"), "raw"))


SAMPLES_SQL = "s as (select event_type as part_type, 'm' || (event_id % 3) as metric, case event_id % 5 when 0 then 'true' when 1 then 'nan' when 2 then 'x' else cast(value as varchar) end as value, user_id % 2 = 0 as active from events)"


@query("with " + SAMPLES_SQL + " select part_type, metric, count(*) as n, round(median(cast(value as double)), 4) as median from s where active and value not in ('true', 'nan', 'x') group by 1, 2")
def agg38_pooled(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id") % 5
    value = F.when(e == 0, "true").when(e == 1, "nan").when(e == 2, "x").otherwise(F.col("value").cast("string"))
    s = table(spark, d, "events").select(F.col("event_type").alias("part_type"), F.concat(F.lit("m"), (F.col("event_id") % 3).cast("string")).alias("metric"), value.alias("value"), (F.col("user_id") % 2 == 0).alias("active"))
    return songs.pooled(s).groupBy("part_type", "metric").agg(F.count("*").alias("n"), r4(F.median("value"), "median"))


@query("with s as (select ['mix', 'vocal', 'bass'][n_nationkey % 3 + 1] as part_type, ['sung_wer', 'f0', 'sung_wer_excess', 'chroma'][n_nationkey % 4 + 1] as metric, n_nationkey from nation) select * from s where part_type <> 'mix' and not (part_type = 'vocal' and metric in ('sung_wer', 'sung_wer_excess', 'sung_wer_original'))")
def cal3_measured(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("n_nationkey")
    pick = lambda *names: F.get(F.array(*(F.lit(n) for n in names)), k % len(names))
    return songs.measured(table(spark, d, "nation").select(pick("mix", "vocal", "bass").alias("part_type"), pick("sung_wer", "f0", "sung_wer_excess", "chroma").alias("metric"), k))


HISTORY_SQL = """l as (select l_returnflag as song, l_linestatus as part, cast(quarter(l_shipdate) as bigint) as q, l_quantity as v, l_discount as d from lineitem),
 s as (select song, part, 'q' || q || '@' || ((q * 70) // 60) || ':' || lpad(cast((q * 70) % 60 as varchar), 2, '0') as key, round(avg(v), 2) as score from l group by song, part, q), m as (select song, part, string_agg(key || '=' || cast(score as varchar), ';' order by key) as sections from s group by 1, 2)"""


@query("with " + HISTORY_SQL + " select song, part, round(avg(v), 2) as score, sections from l join m using (song, part) group by song, part, sections")
def his1_history(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("song"), F.col("l_linestatus").alias("part"), F.quarter("l_shipdate").alias("q"), F.col("l_quantity").alias("v"))
    by = ["song", "part"]
    s = li.groupBy(*by, "q").agg(F.round(F.avg("v"), 2).alias("score")).withColumn("label", F.concat(F.lit("q"), F.col("q").cast("string"))).withColumn("a", F.col("q") * 70.0)
    p = li.groupBy(*by).agg(F.round(F.avg("v"), 2).alias("score")).withColumn("what", F.col("score")).withColumn("sound", F.col("score")).withColumn("dyn", F.lit(None).cast("double"))
    h = songs.history_parts(s, p, by)
    return h.select(*by, "score", F.array_join(F.transform(F.map_entries("sections"), lambda x: F.concat(x["key"], F.lit("="), x["value"].cast("string"))), ";").alias("sections"))


RUNS_SQL = "r as (select o_orderpriority as song, o_orderstatus as part, year(o_orderdate) as y, avg(o_totalprice) / 2000 as score from orders group by 1, 2, 3), b as (select * from r where y = 1996), a as (select * from r where y = 1997)"


@query("with " + RUNS_SQL + " select song, part, round(b.score, 4) as before, round(a.score, 4) as after, case when a.score - b.score >= 5 then 'improved' when a.score - b.score <= -5 then 'regressed' else 'same' end as verdict from a join b using (song, part)")
def his2_changes(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("song"), F.col("o_orderstatus").alias("part"), F.year("o_orderdate").alias("y")).agg((F.avg("o_totalprice") / 2000).alias("score"))
    return songs.changes(r.where("y = 1996"), r.where("y = 1997"), ["song", "part"]).select("song", "part", r4(F.col("before"), "before"), r4(F.col("after"), "after"), "verdict")


LAG_SQL = "w as (select user_id % 10 as song, event_type as part, cast(floor(t / 259200) as bigint) as slot, min(event_id) as e from ev where t < 2592000 group by 1, 2, 3), v as (select song, part, slot * 10.0 as a, slot * 10.0 + 20 as b, case when e % 4 <> 0 then (e * 13) % 101 - 50 end::double as lag_ms from w)"


@query("with {ev}, " + LAG_SQL + ", d as (select song, string_agg(distinct part, ',' order by part) as drifting from v where abs(lag_ms) > 30 group by 1) select song, part, ((a + b) / 2)::double as mid, lag_ms, drifting from v left join d using (song) qualify count(lag_ms) over (partition by song, part) > 0")
def rpt4_lag_series(spark: SparkSession, d: str) -> DataFrame:
    w = events(spark, d).where("t < 2592000").groupBy((F.col("user_id") % 10).alias("song"), F.col("event_type").alias("part"), F.floor(F.col("t") / 259200).alias("slot")).agg(F.min("event_id").alias("e"))
    v = w.select("song", "part", (F.col("slot") * 10.0).alias("a"), (F.col("slot") * 10.0 + 20).alias("b"), F.when(F.col("e") % 4 != 0, ((F.col("e") * 13) % 101 - 50).cast("double")).alias("lag_ms"))
    series, drifting = songs.lag_series(v, ["song"], "part")
    return series.join(drifting, "song", "left")


@query("with {ev}, " + FRAMES_SQL + ", " + raw_sql("song, part") + ", l as (select song, part, 20 * log10(nullif(sqrt(avg(r * r)), 0)) as ref_db, 20 * log10(nullif(sqrt(avg(e * e)), 0)) as est_db from frames group by all) select song, part, 'levels' as measure, round(ref_db, 4) as ref, round(est_db, 4) as est, round(est_db - ref_db, 4) as value from l union all select song, part, metric, null, null, round(raw, 4) from metrics")
def rpt6_compare(spark: SparkSession, d: str) -> DataFrame:
    """The comparison of every part in long form: levels of both sides, and each metric."""
    f = frames(spark, d)
    ref, est = measures.level_db(F.col("r")), measures.level_db(F.col("e"))
    levels = f.groupBy("song", "part").agg(r4(ref, "ref"), r4(est, "est"), r4(est - ref, "value")).select("song", "part", F.lit("levels").alias("measure"), "ref", "est", "value")
    none = F.lit(None).cast("double")
    return levels.union(raw_metrics(f, ["song", "part"]).select("song", "part", "metric", none, none, r4(F.col("raw"), "raw")))


@query("with {ev}, " + FRAMES_SQL + ", " + raw_sql("song, part") + ", p as (select song, part, (song + length(part)) % 4 = 0 as silent, case when (song * length(part)) % 5 <> 0 then score end as score from parts) select song, part, silent, round(score, 4) as score, row_number() over (partition by song order by silent, case when silent then 0 else coalesce(score, 0) end, part) as rank from p")
def srt3_part_order(spark: SparkSession, d: str) -> DataFrame:
    n = F.length("part")
    p = part_scores(frames(spark, d), ["song", "part"]).withColumn("silent", (F.col("song") + n) % 4 == 0).withColumn("score", F.when((F.col("song") * n) % 5 != 0, F.col("score")))
    return songs.part_order(p, ["song"], "part", "silent", "score").select("song", "part", "silent", r4(F.col("score"), "score"), "rank")


@query("with w as (select n_nationkey, case when n_nationkey % 6 <> 0 then n_nationkey * 300.0 end as duration from nation) select n_nationkey, c_custkey, round(c_acctbal, 2) as length from customer join w on n_nationkey = c_nationkey where c_custkey % 3 <> 0 qualify row_number() over (partition by n_nationkey order by abs(c_acctbal - duration) nulls first, c_custkey) = 1")
def srt6_candidate(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("n_nationkey")
    wanted = table(spark, d, "nation").select(k, F.when(k % 6 != 0, k * 300.0).alias("duration"))
    found = table(spark, d, "customer").select(F.col("c_nationkey").alias("n_nationkey"), "c_custkey", F.col("c_acctbal").alias("length"), F.when(F.col("c_custkey") % 3 != 0, "words").otherwise("").alias("lyrics"))
    return songs.candidates(found, wanted, ["n_nationkey"], "length", "c_custkey").select("n_nationkey", "c_custkey", F.round("length", 2).alias("length"))


FILE_ANCHORS = [(t, *a) for t in ("vocal", "bass") for a in ANCHORS]
FILE_SQL = "a(part_type, metric, floor, ceiling, weight, axis, floor_cap) as (values " + ", ".join("(" + ", ".join("null" if x is None else f"'{x}'" if isinstance(x, str) else f"{x}::double" for x in r) + ")" for r in FILE_ANCHORS) + ")"


@query("with " + FILE_SQL + """, l as (select part_type, 1 as block, metric, '    "' || metric || '": {"floor": ' || floor || ', "ceiling": ' || ceiling || ', "weight": ' || weight || ', "axis": "' || axis || '"' || coalesce(', "floor_cap": ' || floor_cap, '') || '}' || case when lead(metric) over (partition by part_type order by metric) is not null then ',' else '' end as line from a
 union all select distinct part_type, 0, '', '  "' || part_type || '": {' from a union all select part_type, 2, '', case when part_type = 'vocal' then '  }' else '  },' end from (select distinct part_type from a) union all select '', -1, '', '{' union all select '~', 3, '', '}') select row_number() over (order by part_type, block, metric) as pos, line from l""")
def snk6_anchor_file(spark: SparkSession, d: str) -> DataFrame:
    a = spark.createDataFrame(FILE_ANCHORS, "part_type string, metric string, floor double, ceiling double, weight double, axis string, floor_cap double")
    return songs.anchor_lines(a, ["floor_cap"])


REPORT_SQL = """r as (select o_orderpriority as tier, o_orderstatus as song, cast(year(o_orderdate) as varchar) as part, avg(o_totalprice) / 2000 as score from orders group by 1, 2, 3), t as (select tier, song, part, score as what, score / 2 as sound, case when part <> '1996' then score / 3 end as dyn, score, lag(score) over (partition by tier, song order by part) as before from r),
 f as (select *, cast(cast(round_even(what, 0) as bigint) as varchar) as w, cast(cast(round_even(sound, 0) as bigint) as varchar) as s, coalesce(cast(cast(round_even(dyn, 0) as bigint) as varchar), '—') as y, cast(cast(round_even(score, 0) as bigint) as varchar) as sc, cast(cast(round_even(before, 0) as bigint) as varchar) as b,
  case when before is not null then '(' || case when round_even(score - before, 0) >= 0 then '+' else '' end || cast(round_even(score - before, 0) as bigint) || ')' end as delta from t),
 k as (select distinct tier from t),
 l as (select tier, 2 as block, 0.0::double as key, song as a, part as p, '| ' || song || ' | ' || part || ' | ' || w || ' | ' || s || ' | ' || y || ' | ' || sc || ' | ' || coalesce(delta, '') || ' |' as line from f
  union all select tier, 0, 0, '', '', '## Tier ' || tier from k union all select tier, 1, 0, '', '', '| song | part | what | sound | dyn | score | change |' from k
  union all select tier, 3, 0, '', '', '### Improved (≥ +5)' from k union all select tier, 5, 0, '', '', '### Regressed (≤ −5)' from k
  union all select tier, 4, before - score, song, part, '- ' || song || ' ' || part || ': ' || b || ' → ' || sc || ' ' || delta from f where score - before >= 5 union all select tier, 6, score - before, song, part, '- ' || song || ' ' || part || ': ' || b || ' → ' || sc || ' ' || delta from f where score - before <= -5
  union all select tier, 4, 0, '', '', '_none_' from k where tier not in (select tier from t where score - before >= 5) union all select tier, 6, 0, '', '', '_none_' from k where tier not in (select tier from t where score - before <= -5))"""


@query("with " + REPORT_SQL + " select tier, row_number() over (partition by tier order by block, key, a, p) as pos, line from l")
def snk8_report(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("tier"), F.col("o_orderstatus").alias("song"), F.year("o_orderdate").cast("string").alias("part")).agg((F.avg("o_totalprice") / 2000).alias("score"))
    before = F.lag("score").over(Window.partitionBy("tier", "song").orderBy("part"))
    t = r.withColumn("what", F.col("score")).withColumn("sound", F.col("score") / 2).withColumn("dyn", F.when(F.col("part") != "1996", F.col("score") / 3)).withColumn("before", before)
    return songs.report_lines(t, "tier", "song", "part")


@query("with l as (select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as pos from documents) select doc_id, arg_max(line, pos) as line from l where not contains(line, ' - INFO - ') and not contains(line, 'it/s]') and trim(line) <> '' group by 1")
def aux11_last_line(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return songs.last_line(lines, ["doc_id"], "pos", "line")


@query("with s as (select n_regionkey, n_nationkey, case n_nationkey % 4 when 0 then 'voice.lead.soul' when 1 then 'keys.ep' else 'unknown' end as inst, case when n_nationkey % 5 = 1 then 'lead_vocals' end as stem, case when n_nationkey % 6 = 2 then 'vox' else 'x' end as name from nation), r as (select *, case when inst like 'voice.lead%' then 0 when stem = 'lead_vocals' then 1 when name = 'vox' then 2 end as k from s) select n_regionkey, n_nationkey from r where k is not null qualify row_number() over (partition by n_regionkey order by k, n_nationkey) = 1")
def aux7_vocal_stream(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("n_nationkey")
    s = table(spark, d, "nation").select("n_regionkey", k, F.when(k % 4 == 0, "voice.lead.soul").when(k % 4 == 1, "keys.ep").otherwise("unknown").alias("inst"), F.when(k % 5 == 1, "lead_vocals").alias("stem"), F.when(k % 6 == 2, "vox").otherwise("x").alias("name"))
    return songs.vocal_stream(s, ["n_regionkey"], "inst", "stem", "name", "n_nationkey").select("n_regionkey", "n_nationkey")


@query("with b as (select p_brand as song, count(*) as clips, cast(sum(p_size) * 4 + 44 as bigint) as bytes, sum(p_size) as frames from part group by 1) select count(*) as songs, cast(sum(clips) as bigint) as clips, cast(sum(bytes) as bigint) as bytes, round(sum(frames) / 44.1, 4)::double as seconds, case when sum(bytes) > 0 then '(' || case when sum(bytes) >= 1000 then '+' else '' end || cast(sum(bytes) - 1000 as bigint) || ')' end as change from b")
def agg37_totals(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "part").groupBy("p_brand").agg(F.count("*").alias("clips"), (F.sum("p_size") * 4 + 44).alias("bytes"), F.sum("p_size").alias("frames"))
    return b.agg(F.count("*").alias("songs"), F.sum("clips").alias("clips"), F.sum("bytes").alias("bytes"), r4(F.sum("frames") / 44.1, "seconds"), delta(F.sum("bytes") - 1000).alias("change"))
