"""Queries over the driver's tables, groups A to E: scans, text and scalars, joins, windows, measures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import pitch, text
from ..operators import joins, measures, series
from .base import events, query, r4, table

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings"]
H = 3600.0


@query(" union all ".join(f"select '{t}' as name, count(*) as n from {t}" for t in TABLES))
def src1_scan_all(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for t in TABLES:
        one = table(spark, d, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("name"), "n")
        out = one if out is None else out.union(one)
    return out


@query("""with {ev} select event_id, cast(floor(t / 7200) as bigint) + 1 as bar, round((t - floor(t / 7200) * 7200) / 1800 + 1, 3) as beat, event_type as atom, cast(round_even(value / 4, 0) as bigint) as vel from ev""")
def prs5_time_tokens(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    bar = F.floor(F.col("t") / 7200) + 1
    beat = (F.col("t") - (bar - 1) * 7200) / 1800 + 1
    line = F.format_string("%d:%s %s %d", bar, F.format_string("%.3f", F.round(beat, 3)), F.col("event_type"), F.bround(F.col("value") / 4, 0).cast("long"))
    return text.parse_event_line(e.select("event_id", line.alias("line")), "line").select("event_id", "bar", "beat", "atom", "vel")


@query("""select event_id, cast(json_extract_string(props, '$.k') as bigint) as k, cast(json_extract_string(props, '$.k') as double) / 100 as share from events""")
def prs10_kv_map(spark: SparkSession, d: str) -> DataFrame:
    m = F.from_json("props", "map<string,string>")
    k = m["k"].try_cast("long")
    return events(spark, d).select("event_id", k.alias("k"), (k / 100.0).alias("share"))


NAMES_SQL = "['C','C#','D','D#','E','F','F#','G','G#','A','A#','B']"


@query(f"""with c as (select event_id, 6900 + 1200 * log2(value / 440) as cents from events where value > 0), n as (select *, cast(round_even(cents / 100, 0) as bigint) as sn from c)
 select event_id, round(cents, 4) as cents, {NAMES_SQL}[cast((sn % 12 + 12) % 12 as int) + 1] || cast(cast(floor(sn / 12.0) as bigint) - 1 as varchar) as note, round(cents - sn * 100, 4) as off, round(440 * pow(2, (cents - 6900) / 1200), 4) as hz from n""")
def scl2_cents(spark: SparkSession, d: str) -> DataFrame:
    c = events(spark, d).where("value > 0").withColumn("cents", pitch.hz_to_cents(F.col("value")))
    semi = pitch.semitone(F.col("cents"))
    return c.select("event_id", r4(F.col("cents"), "cents"), pitch.note_name(semi).alias("note"), r4(F.col("cents") - semi * 100, "off"), r4(pitch.cents_to_hz(F.col("cents")), "hz"))


@query("""with {ev}, b as (select event_id, t / 1800 as beats from ev), q as (select *, round_even(beats * 2, 0) / 2 as grid from b)
 select event_id, cast(floor(grid / 4) as bigint) + 1 as bar, grid - floor(grid / 4) * 4 + 1 as beat, round((beats - grid) * 1800, 4) as dev from q""")
def scl6_bar_beat(spark: SparkSession, d: str) -> DataFrame:
    b = events(spark, d).withColumn("beats", F.col("t") / 1800).withColumn("grid", F.rint(F.col("beats") * 2) / 2)
    return b.select("event_id", (F.floor(F.col("grid") / 4) + 1).alias("bar"), (F.col("grid") - F.floor(F.col("grid") / 4) * 4 + 1).alias("beat"), r4((F.col("beats") - F.col("grid")) * 1800, "dev"))


@query("""with w as (select lang, unnest(string_split(replace(lower(text), '-', ' '), ' ')) as w from documents), n as (select lang, trim(regexp_replace(w, '[^a-z0-9'']', '', 'g'), '''') as word from w)
 select lang, word, count(*) as n from n where word <> '' group by lang, word""")
def scl8_tokens(spark: SparkSession, d: str) -> DataFrame:
    return text.word_counts(table(spark, d, "documents"), "text", ["lang"])


@query("""with {ev}, g as (select user_id, event_type, sum(value) as s, max(t) as last from ev group by 1, 2)
 select user_id, event_type, regexp_replace(lower(event_type || ' ' || user_id || '!'), '[^a-z0-9]+', '-', 'g') as slug, cast(floor(last / 60) as bigint) || ':' || lpad(cast(cast(floor(last) as bigint) % 60 as varchar), 2, '0') as at,
 case when round_even(s - 1000, 0) = 0 then '(+0)' when s > 1000 then '(+' || cast(round_even(s - 1000, 0) as bigint) || ')' else '(' || cast(round_even(s - 1000, 0) as bigint) || ')' end as delta from g""")
def scl11_labels(spark: SparkSession, d: str) -> DataFrame:
    # values are added in the events' order, or a sum at a half would be rounded by how its rows were dealt out
    w = Window.partitionBy("user_id", "event_type").orderBy("event_id", "us", "value")
    e = events(spark, d).select("user_id", "event_type", "t", F.sum("value").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("s"), F.row_number().over(w).alias("n"))
    g = e.groupBy("user_id", "event_type").agg(F.max_by("s", "n").alias("s"), F.max("t").alias("last"))
    name = F.concat("event_type", F.lit(" "), "user_id", F.lit("!"))
    return g.select("user_id", "event_type", F.when(name.isNotNull(), text.slug(name)).alias("slug"), text.minutes(F.col("last"), signed=True).alias("at"), text.delta(F.col("s") - 1000).alias("delta"))


@query("""select event_type, case event_type when 'click' then 'keys' when 'view' then 'strings' when 'purchase' then 'drums' else 'other' end as family, count(*) as n from events group by 1""")
def scl14_dim_fallback(spark: SparkSession, d: str) -> DataFrame:
    dim = spark.createDataFrame([("click", "keys"), ("view", "strings"), ("purchase", "drums")], "event_type string, family string")
    e = events(spark, d).groupBy("event_type").agg(F.count("*").alias("n"))
    return e.join(F.broadcast(dim), "event_type", "left").select("event_type", F.coalesce("family", F.lit("other")).alias("family"), "n")


@query("""with {ev}, a as (select distinct user_id, event_type from ev where t < 1296000), b as (select distinct user_id, event_type from ev where t >= 1296000)
 select user_id, event_type, a.user_id is not null as first_half, b.user_id is not null as second_half, case when a.user_id is null then 'extra' when b.user_id is null then 'missing' else 'ok' end as state from a full outer join b using (user_id, event_type)""")
def jon1_full_outer(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    a = e.where("t < 1296000").select("user_id", "event_type").distinct().withColumn("first_half", F.lit(True))
    b = e.where("t >= 1296000").select("user_id", "event_type").distinct().withColumn("second_half", F.lit(True))
    x = a.join(b, ["user_id", "event_type"], "full_outer").na.fill(False)
    return x.withColumn("state", F.when(~F.col("first_half"), "extra").when(~F.col("second_half"), "missing").otherwise("ok"))


@query("""with {ev}, c as (select * from ev where event_type = 'click'), m as (select * from ev where event_type <> 'click'),
 j as (select c.user_id, c.event_id, m.event_type as family, row_number() over (partition by c.event_id order by (m.event_type = 'view') desc, m.event_id) as rn from c join m on c.user_id = m.user_id and abs(c.t - m.t) <= 3600 and abs(c.value - m.value) <= 50),
 v as (select user_id, family, count(*) as votes from j where rn = 1 group by 1, 2)
 select user_id, family, votes, round(votes * 1.0 / sum(votes) over (partition by user_id), 4) as share, case when sum(votes) over (partition by user_id) < 5 then 'prior' when votes * 1.0 / sum(votes) over (partition by user_id) >= 0.6 then 'reassign' else 'keep' end as decision from v""")
def jon3_range_vote(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    c = e.where("event_type = 'click'").select("user_id", "event_id", "t", "value")
    m = e.where("event_type <> 'click'").select("user_id", F.col("event_id").alias("m_id"), F.col("t").alias("mt"), F.col("value").alias("mv"), F.col("event_type").alias("family"))
    pairs = joins.range_join(c, m, ["user_id"], "t", "mt", H).where(F.abs(F.col("value") - F.col("mv")) <= 50)
    best = series.top_k(pairs, ["event_id"], [(F.col("family") == "view").desc(), F.col("m_id")], 1)
    v = best.groupBy("user_id", "family").agg(F.count("*").alias("votes"))
    total = F.sum("votes").over(Window.partitionBy("user_id"))
    share = F.col("votes") / total
    return v.select("user_id", "family", "votes", r4(share, "share"), F.when(total < 5, "prior").when(share >= 0.6, "reassign").otherwise("keep").alias("decision"))


@query()
def jon4_match_1d(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    return joins.match_counts(e.where("event_type = 'view'"), e.where("event_type = 'click'"), ["user_id"], "t", 6 * H)


@query()
def jon5_match_2d(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    return joins.match_counts(e.where("event_type = 'view'"), e.where("event_type = 'click'"), ["user_id"], "t", 6 * H, "value", 100.0)


@query("""with {ev} select p.event_id, p.user_id, s.event_id as signup_id, round(p.t - s.t, 4) as age from (select * from ev where event_type = 'purchase') p asof left join (select * from ev where event_type = 'signup') s on p.user_id = s.user_id and p.t >= s.t""")
def jon8_asof(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).select("event_id", "user_id", "event_type", "t")
    x = joins.asof_join(e.where("event_type = 'purchase'"), e.where("event_type = 'signup'"), ["user_id"], "t", F.struct("event_id", "t"), "s")
    return x.select("event_id", "user_id", F.col("s.event_id").alias("signup_id"), r4(F.col("t") - F.col("s.t"), "age"))


@query("""with {ev}, j as (select p.event_id, p.user_id, e.event_id as error_id, abs(p.t - e.t) as dist, row_number() over (partition by p.event_id order by abs(p.t - e.t), e.t) as rn from ev p join ev e on p.user_id = e.user_id and e.event_type = 'error' where p.event_type = 'purchase')
 select p.event_id, p.user_id, error_id, round(dist, 4) as dist from (select * from ev where event_type = 'purchase') p left join (select * from j where rn = 1) j on p.event_id = j.event_id""")
def jon9_nearest(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).select("event_id", "user_id", "event_type", "t")
    x = joins.nearest_join(e.where("event_type = 'purchase'"), e.where("event_type = 'error'"), ["user_id"], "t", "event_id", "error_id")
    return x.select("event_id", "user_id", "error_id", r4(F.col("error_id_distance"), "dist"))


@query("""with {ev} select x.event_id as left_id, y.event_id as right_id, round(greatest(x.t, y.t), 4) as a, round(least(x.t + x.value * 60, y.t + y.value * 60), 4) as b from ev x join ev y on x.user_id = y.user_id and x.event_type = 'view' and y.event_type = 'click' where least(x.t + x.value * 60, y.t + y.value * 60) - greatest(x.t, y.t) > 60""")
def jon10_overlap(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).withColumn("end", F.col("t") + F.col("value") * 60)
    left = e.where("event_type = 'view'").select("user_id", F.col("event_id").alias("left_id"), F.col("t").alias("a0"), F.col("end").alias("b0"))
    right = e.where("event_type = 'click'").select("user_id", F.col("event_id").alias("right_id"), F.col("t").alias("a1"), F.col("end").alias("b1"))
    return joins.overlap_join(left, right, ["user_id"], 6 * H, 60.0).select("left_id", "right_id", r4(F.col("a"), "a"), r4(F.col("b"), "b"))


@query("""with {ev} select event_id, user_id from ev a where not exists (select 1 from ev b where a.user_id = b.user_id and a.event_id <> b.event_id and abs(a.t - b.t) <= 3600)""")
def jon11_anti_interval(spark: SparkSession, d: str) -> DataFrame:
    near = F.count("*").over(Window.partitionBy("user_id").orderBy("us").rangeBetween(-3600000000, 3600000000))
    return events(spark, d).withColumn("n", near).where("n = 1").select("event_id", "user_id")


@query("""with e as (select label, unnest(embedding)::double as v, unnest(range(len(embedding))) as pos from embeddings), m as (select label, pos, avg(v) as v from e group by 1, 2), n as (select label, sqrt(sum(v * v)) as n from m group by 1)
 select a.label as a, b.label as b, round(sum(a.v * b.v) / (any_value(na.n) * any_value(nb.n)), 4) as cosine from m a join m b on a.pos = b.pos and a.label <> b.label join n na on na.label = a.label join n nb on nb.label = b.label group by 1, 2""")
def jon13_cross_pairs(spark: SparkSession, d: str) -> DataFrame:
    return measures.pooled_cosine(table(spark, d, "embeddings"), "label", "embedding").select("a", "b", r4(F.col("cosine"), "cosine"))


HOURLY_SQL = "g as (select unnest(range(720)) as frame), p as (select distinct event_type from ev), f as (select event_type, frame, coalesce(n, 0) as n, coalesce(v, 0) as v from g cross join p left join (select event_type, cast(floor(t / 3600) as bigint) as frame, count(*) as n, sum(value) as v from ev group by 1, 2) using (event_type, frame))"


def hourly(spark: SparkSession, d: str) -> DataFrame:
    """(event_type, frame, n, v) for 720 hours, zeros where nothing happened: a grid of the event types, not of the rows."""
    e = events(spark, d)
    grid = e.select("event_type").distinct().withColumn("frame", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(719).cast("long"))))
    got = e.groupBy("event_type", F.floor(F.col("t") / H).alias("frame")).agg(F.count("*").alias("n"), F.sum("value").alias("v"))
    return grid.join(got, ["event_type", "frame"], "left").na.fill(0, ["n"]).na.fill(0.0, ["v"])


@query("with {ev}, " + HOURLY_SQL + """ select a.event_type as a, b.event_type as b, round(corr(a.v, b.v), 4) as r, count(*) as frames from f a join f b on a.frame = b.frame and a.event_type < b.event_type group by 1, 2""")
def jon14_zip_frames(spark: SparkSession, d: str) -> DataFrame:
    f = hourly(spark, d)
    a, b = f.select(F.col("event_type").alias("a"), "frame", F.col("v").alias("x")), f.select(F.col("event_type").alias("b"), "frame", F.col("v").alias("y"))
    return a.join(b, "frame").where("a < b").groupBy("a", "b").agg(r4(measures.pearson(F.col("x"), F.col("y")), "r"), F.count("*").alias("frames"))


LAG_SQL = "c as (select lag, corr(x.n, y.n) as r from (select unnest(range(-36, 37)) as lag) l join f x on x.event_type = 'view' join f y on y.event_type = 'click' and y.frame = x.frame + l.lag group by lag)"


@query("with {ev}, " + HOURLY_SQL + ", " + LAG_SQL + """, k as (select *, lag(r) over (order by lag) as l, lead(r) over (order by lag) as h, max(r) over () as best from c)
 select lag, round(r, 4) as r, abs(lag) > 1 as drift from k where (l is null or r >= l) and (h is null or r >= h) and r >= best - 0.05 order by abs(lag), r desc limit 1""")
def jon16_lag_corr(spark: SparkSession, d: str) -> DataFrame:
    f = hourly(spark, d)
    x = f.where("event_type = 'view'").select("frame", F.col("n").cast("double").alias("x"))
    y = f.where("event_type = 'click'").select(F.col("frame").alias("yf"), F.col("n").cast("double").alias("y"))
    shifted = x.withColumn("lag", F.explode(F.sequence(F.lit(-36), F.lit(36)))).withColumn("yf", F.col("frame") + F.col("lag"))
    c = shifted.join(y, "yf").groupBy("lag").agg(measures.pearson(F.col("x"), F.col("y")).alias("r"))
    w = Window.orderBy("lag")
    k = c.withColumn("l", F.lag("r").over(w)).withColumn("h", F.lead("r").over(w)).withColumn("best", F.max("r").over(Window.partitionBy()))
    peak = k.where("(l is null or r >= l) and (h is null or r >= h) and r >= best - 0.05")
    return peak.orderBy(F.abs("lag"), F.desc("r")).limit(1).select(F.col("lag").cast("long").alias("lag"), r4(F.col("r"), "r"), (F.abs("lag") > 1).alias("drift"))


SLIDE_SQL = "w as (select i as pos, i * 36000.0 as a, least(i * 36000.0 + 72000, 2592000) as b from (select unnest(range(71)) as i))"


@query("with {ev}, " + SLIDE_SQL + " select pos, a::double as a, b::double as b, event_type, count(*) as n, round(avg(value), 4) as mean from w join ev on t >= a and t < b group by 1, 2, 3, 4")
def jon17_in_slice(spark: SparkSession, d: str) -> DataFrame:
    x = series.in_windows(events(spark, d), "t", 20 * H, 10 * H, 720 * H)
    return x.groupBy("pos", "a", "b", "event_type").agg(F.count("*").alias("n"), r4(F.avg("value"), "mean"))


@query("with " + SLIDE_SQL + " select pos, a::double as a, b::double as b, cast(floor(a / 60) as bigint) || ':' || lpad(cast(cast(a as bigint) % 60 as varchar), 2, '0') as label from w")
def win1_sliding(spark: SparkSession, d: str) -> DataFrame:
    return series.sliding(spark, 20 * H, 10 * H, 720 * H).withColumn("label", text.minutes(F.col("a")))


@query("""with m as (select o_orderpriority as label, date_trunc('month', o_orderdate) as m from orders group by 1, 2), s as (select *, (year(m) * 12 + month(m)) as k from m where hash_free_pick(label, m)), x as (select label, k, lead(k) over (order by k, label) as nxt from s) select label, k, nxt from x""".replace("where hash_free_pick(label, m)", "where (year(m) * 12 + month(m)) % 5 = cast(substr(label, 1, 1) as int) - 1").replace("select label, k, nxt from x", "select label, cast(k as bigint) as a, cast(least(k + 3, coalesce(nxt, k + 3)) as bigint) as b from x where least(k + 3, coalesce(nxt, k + 3)) > k"))
def win2_sections(spark: SparkSession, d: str) -> DataFrame:
    m = F.date_trunc("month", F.col("o_orderdate").cast("timestamp"))
    s = table(spark, d, "orders").select(F.col("o_orderpriority").alias("label"), (F.year(m) * 12 + F.month(m)).cast("long").alias("a")).distinct()
    s = s.where(F.col("a") % 5 == F.substring("label", 1, 1).cast("int") - 1)
    nxt = F.lead("a").over(Window.orderBy("a", "label"))
    return s.withColumn("b", F.least(F.col("a") + 3, F.coalesce(nxt, F.col("a") + 3))).where("b > a").select("label", "a", "b")


@query("""with {ev}, f as (select event_type, cast(floor(t / 86400) as bigint) as block, cast(floor(t / 3600) as bigint) as frame, avg(value * value) as p, sum(value * value) as e, count(*) as n from ev group by 1, 2, 3)
 select event_type, block, round(10 * log10(sum(e) / sum(n)), 4) as level, round(10 * log10(max(p)), 4) as loudest from f group by 1, 2""")
def win4_tumbling(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("value")
    f = events(spark, d).groupBy("event_type", F.floor(F.col("t") / 86400).alias("block"), F.floor(F.col("t") / H).alias("frame")).agg(F.avg(v * v).alias("p"), F.sum(v * v).alias("e"), F.count("*").alias("n"))
    return f.groupBy("event_type", "block").agg(r4(10 * F.log10(F.nullif(F.sum("e") / F.sum("n"), F.lit(0.0))), "level"), r4(10 * F.log10(F.nullif(F.max("p"), F.lit(0.0))), "loudest"))


@query("""with {ev}, x as (select user_id, event_type, event_id, value, t as a, t + value * 60 as b from ev), r as (select *, max(b) over (partition by user_id, event_type order by a, event_id rows between unbounded preceding and 1 preceding) as reach from x),
 i as (select *, sum(case when a > reach + 1800 then 1 else 0 end) over (partition by user_id, event_type order by a, event_id rows unbounded preceding) as island from r)
 select user_id, event_type, cast(island as bigint) as island, round(min(a), 4) as a, round(max(b), 4) as b, count(*) as n, max(value) as amp, arg_min(event_id, (a, event_id)) as bend from i group by 1, 2, 3""")
def win6_merge(spark: SparkSession, d: str) -> DataFrame:
    x = events(spark, d).select("user_id", "event_type", "event_id", F.col("t").alias("a"), (F.col("t") + F.col("value") * 60).alias("b"), F.col("value").alias("amp"), F.col("event_id").alias("bend"))
    m = series.merge_intervals(x, ["user_id", "event_type"], "a", "b", 1800.0, ["event_id"], most=["amp"], first=["bend"])
    return m.select("user_id", "event_type", "island", r4(F.col("a"), "a"), r4(F.col("b"), "b"), "n", "amp", "bend")


@query("""with {ev}, x as (select *, t - lag(t) over (partition by user_id order by t, event_id) > 21600 as s from ev), i as (select *, sum(case when s then 1 else 0 end) over (partition by user_id order by t, event_id rows unbounded preceding) as phrase from x)
 select user_id, cast(phrase as bigint) as phrase, count(*) as n, round(min(t), 4) as a, round(max(t), 4) as b, round(avg(value), 4) as mean from i group by 1, 2""")
def win7_islands(spark: SparkSession, d: str) -> DataFrame:
    gap = F.col("t") - F.lag("t").over(Window.partitionBy("user_id").orderBy("t", "event_id")) > 6 * H
    i = series.islands(events(spark, d).withColumn("gap", gap), ["user_id"], ["t", "event_id"], F.col("gap"), "phrase")
    return i.groupBy("user_id", "phrase").agg(F.count("*").alias("n"), r4(F.min("t"), "a"), r4(F.max("t"), "b"), r4(F.avg("value"), "mean"))


@query("""with {ev}, i as (select *, row_number() over (partition by user_id order by t, event_id) - 1 as i from ev), s as (select *, max(t - 300 * i) over (partition by user_id order by t, event_id rows unbounded preceding) + 300 * i as start from i)
 select event_id, round(start, 4) as start, round(least(greatest(t + value * 60, start + 120), coalesce(lead(start) over (partition by user_id order by t, event_id), 1e18)), 4) as stop from s""")
def win10_nudge(spark: SparkSession, d: str) -> DataFrame:
    s = series.nudge(events(spark, d), ["user_id"], "t", ["event_id"], 300.0, "start")
    nxt = F.lead("start").over(Window.partitionBy("user_id").orderBy("t", "event_id"))
    return s.select("event_id", r4(F.col("start"), "start"), r4(F.least(F.greatest(F.col("t") + F.col("value") * 60, F.col("start") + 120), F.coalesce(nxt, F.lit(1e18))), "stop"))


@query("""with {ev}, x as (select *, case when event_id % 3 = 0 then null else value end as v, row_number() over (partition by user_id order by event_id) as i from ev),
 y as (select *, last_value(case when v is not null then i end ignore nulls) over b as i0, first_value(case when v is not null then i end ignore nulls) over f as i1, last_value(v ignore nulls) over b as v0, first_value(v ignore nulls) over f as v1 from x
 window b as (partition by user_id order by event_id rows between unbounded preceding and current row), f as (partition by user_id order by event_id rows between current row and unbounded following))
 select event_id, round(case when v is not null then v when v0 is null then v1 else v0 + (v1 - v0) * (i - i0) / nullif(i1 - i0, 0) end, 4) as filled from y""")
def win12_fill(spark: SparkSession, d: str) -> DataFrame:
    x = events(spark, d).withColumn("v", F.when(F.col("event_id") % 3 != 0, F.col("value")))
    return series.fill_linear(x, ["user_id"], "event_id", "v", "filled").select("event_id", r4(F.col("filled"), "filled"))


@query("""with m as (select cast(year(o_orderdate) * 12 + month(o_orderdate) as bigint) as bar, count(*) as beats from orders group by 1), c as (select *, coalesce(sum(beats) over (order by bar rows between unbounded preceding and 1 preceding), 0) as beat0, (bar - min(bar) over ()) as i from m),
 a as (select *, cast(floor(i / 12) as bigint) as seg, i / 12 as q from c), s as (select seg, min(beat0) as b0, sum(beats) as total from a group by 1)
 select bar, cast(beat0 as bigint) as beat0, round(seg * 100.0 + 100.0 * (beat0 - b0) / total, 4) as anchored from a join s using (seg)""")
def win13_cumbeats(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").groupBy((F.year("o_orderdate") * 12 + F.month("o_orderdate")).cast("long").alias("bar")).agg(F.count("*").alias("beats"))
    c = o.withColumn("beat0", F.coalesce(F.sum("beats").over(Window.orderBy("bar").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("seg", F.floor((F.col("bar") - F.min("bar").over(Window.partitionBy())) / 12))
    seg = Window.partitionBy("seg")
    return c.select("bar", "beat0", r4(F.col("seg") * 100.0 + 100.0 * (F.col("beat0") - F.min("beat0").over(seg)) / F.sum("beats").over(seg), "anchored"))


@query("""with q as (select user_id, count(*) as n, quantile_cont(value, 0.05) as lo, quantile_cont(value, 0.95) as hi from events group by 1)
 select event_id, case when n < 5 or hi - lo < 4 then 90 else round(greatest(40, least(120, 40 + 80 * (value - lo) / (hi - lo))), 4) end as vel from events join q using (user_id)""")
def win17_rescale(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    q = e.groupBy("user_id").agg(F.count("*").alias("n"), F.percentile("value", 0.05).alias("lo"), F.percentile("value", 0.95).alias("hi"))
    x = F.lit(40.0) + 80 * (F.col("value") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0))
    return e.join(q, "user_id").select("event_id", F.when((F.col("n") < 5) | (F.col("hi") - F.col("lo") < 4), 90.0).otherwise(F.round(F.greatest(F.lit(40.0), F.least(F.lit(120.0), x)), 4)).alias("vel"))


@query("""with m as (select event_type, median(value) as med from events group by 1), r as (select e.event_type, event_id, user_id, row_number() over (partition by e.event_type order by abs(value - med), event_id) as rank from events e join m using (event_type))
 select event_type, event_id, rank, cast((rank - 1) % 3 as bigint) as slot from r where rank <= 4""")
def win18_topk(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    m = e.groupBy("event_type").agg(F.median("value").alias("med"))
    top = series.top_k(e.join(m, "event_type"), ["event_type"], [F.abs(F.col("value") - F.col("med")), F.col("event_id")], 4)
    return top.select("event_type", "event_id", F.col("rank").cast("long").alias("rank"), ((F.col("rank") - 1) % 3).cast("long").alias("slot"))


@query("""with m as (select o_orderpriority as tier, year(o_orderdate) * 12 + month(o_orderdate) as seq, avg(o_totalprice) as score from orders group by 1, 2), r as (select *, row_number() over (partition by tier order by seq desc) as rn from m)
 select a.tier, cast(a.seq as bigint) as seq, round(a.score, 2) as score, round(a.score - b.score, 2) as diff from r a left join r b on a.tier = b.tier and b.rn = 2 where a.rn = 1""")
def win22_latest_prev(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("tier"), (F.year("o_orderdate") * 12 + F.month("o_orderdate")).cast("long").alias("seq")).agg(F.avg("o_totalprice").alias("score"))
    two = series.top_k(m, ["tier"], [F.desc("seq")], 2)
    now, was = F.max_by("score", "seq"), F.min_by("score", "seq")
    return two.groupBy("tier").agg(F.max("seq").alias("seq"), F.round(now, 2).alias("score"), F.when(F.count("*") > 1, F.round(now - was, 2)).alias("diff"))


@query("""with {ev}, f as (select event_type, cast(floor(t / 86400) as bigint) as block, cast(floor(t / 3600) as bigint) as frame, sqrt(avg(value * value)) as r, sum(value * value) as e, count(*) as n from ev group by 1, 2, 3),
 b as (select event_type, block, max(r) as peak, sqrt(sum(e) / sum(n)) as rms from f group by 1, 2), m as (select block, sqrt(sum(e) / sum(n)) as mix from f group by 1)
 select event_type, block, round(20 * log10(peak), 4) as peak_db, (20 * log10(peak) >= 45 and 20 * log10(rms) >= 20 * log10(mix) - 3) as open from b join m using (block)""")
def flt1_gate(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("value")
    f = events(spark, d).groupBy("event_type", F.floor(F.col("t") / 86400).alias("block"), F.floor(F.col("t") / H).alias("frame")).agg(F.sqrt(F.avg(v * v)).alias("r"), F.sum(v * v).alias("e"), F.count("*").alias("n"))
    b = f.groupBy("event_type", "block").agg(F.max("r").alias("peak"), F.sqrt(F.sum("e") / F.sum("n")).alias("rms"))
    m = f.groupBy("block").agg(F.sqrt(F.sum("e") / F.sum("n")).alias("mix"))
    db = lambda c: 20 * F.log10(c)
    return b.join(m, "block").select("event_type", "block", r4(db(F.col("peak")), "peak_db"), ((db(F.col("peak")) >= 45) & (db(F.col("rms")) >= db(F.col("mix")) - 3)).alias("open"))


@query("""with {ev}, f as (select event_type, cast(floor(t / 72000) as bigint) as slice, cast(floor(t / 3600) as bigint) as frame, sqrt(avg(value * value)) as r from ev where t < 2592000 group by 1, 2, 3)
 select event_type, slice, round(avg(case when 20 * log10(r) >= 48 then 1.0 else 0.0 end), 4) as share, (avg(case when 20 * log10(r) >= 48 then 1.0 else 0.0 end) >= 0.1 and 10 * log10(avg(r * r)) >= 40) as active from f group by 1, 2""")
def flt3_active(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("value")
    f = events(spark, d).where("t < 2592000").groupBy("event_type", F.floor(F.col("t") / 72000).alias("slice"), F.floor(F.col("t") / H).alias("frame")).agg(F.sqrt(F.avg(v * v)).alias("r"))
    loud = F.avg(F.when(20 * F.log10("r") >= 48, 1.0).otherwise(0.0))
    return f.groupBy("event_type", "slice").agg(r4(loud, "share"), ((loud >= 0.1) & (10 * F.log10(F.avg(F.col("r") * F.col("r"))) >= 40)).alias("active"))


@query("""with x as (select *, max(value) over (partition by user_id) as peak from events), k as (select user_id, event_type, count(*) as n, sum(value) as s from x where value >= 0.4 * peak group by 1, 2)
 select user_id, event_type, n, round(s, 4) as sounding, (n < 2 and s < 400) or (n * 1.0 / sum(n) over (partition by user_id) < 0.02 and s / sum(s) over (partition by user_id) < 0.02) as bleed from k""")
def flt5_amp_floor(spark: SparkSession, d: str) -> DataFrame:
    u = Window.partitionBy("user_id")
    k = events(spark, d).withColumn("peak", F.max("value").over(u)).where("value >= 0.4 * peak").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("s"))
    few = (F.col("n") < 2) & (F.col("s") < 400)
    low = (F.col("n") / F.sum("n").over(u) < 0.02) & (F.col("s") / F.sum("s").over(u) < 0.02)
    return k.select("user_id", "event_type", "n", r4(F.col("s"), "sounding"), (few | low).alias("bleed"))


@query("""select user_id, event_type, round(sum(value * value) / sum(sum(value * value)) over (partition by user_id), 4) as energy from events group by 1, 2""")
def agg4_energy_share(spark: SparkSession, d: str) -> DataFrame:
    return measures.energy_share(events(spark, d), ["user_id"], "event_type", "value").select("user_id", "event_type", r4(F.col("energy"), "energy"))


@query("""with e as (select label, unnest(embedding)::double as v, unnest(range(len(embedding))) as pos from embeddings), m as (select label, pos, avg(v) as v from e group by 1, 2), g as (select pos, avg(v) as v from e group by 1)
 select label, round(sum(m.v * g.v) / (sqrt(sum(m.v * m.v)) * sqrt(sum(g.v * g.v))), 4) as cosine from m join g using (pos) group by 1""")
def agg11_pooled_cosine(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("label", F.posexplode(F.col("embedding").cast("array<double>")).alias("pos", "v"))
    sums = e.groupBy("label", "pos").agg(F.avg("v").alias("x"), F.sum("v").alias("s"), F.count("*").alias("n"))
    g = sums.groupBy("pos").agg((F.sum("s") / F.sum("n")).alias("y"))
    dot, nx, ny = F.sum(F.col("x") * F.col("y")), F.sqrt(F.sum(F.col("x") * F.col("x"))), F.sqrt(F.sum(F.col("y") * F.col("y")))
    return sums.join(g, "pos").groupBy("label").agg(r4(F.when(nx * ny > 1e-12, dot / (nx * ny)), "cosine"))


@query("""with {ev}, f as (select event_type, cast(floor(t / 21600) as bigint) % 60 as frame, avg(value) filter (where t < 1296000) as r, avg(value) filter (where t >= 1296000) as e from ev where t < 2592000 group by 1, 2)
 select event_type, count(*) filter (where r > 0 and e > 0) as n, case when count(*) filter (where r > 0 and e > 0) >= 10 then round(median(case when r > 0 and e > 0 then abs(1200 * log2(e / r)) end), 4) end as cents from f group by 1""")
def agg12_median_cents(spark: SparkSession, d: str) -> DataFrame:
    first = F.col("t") < 1296000
    f = events(spark, d).where("t < 2592000").groupBy("event_type", (F.floor(F.col("t") / 21600) % 60).alias("frame")).agg(F.avg(F.when(first, F.col("value"))).alias("r"), F.avg(F.when(~first, F.col("value"))).alias("e"))
    return f.groupBy("event_type").agg(F.count(F.when((F.col("r") > 0) & (F.col("e") > 0), 1)).alias("n"), r4(measures.median_cents(F.col("r"), F.col("e")), "cents"))


@query("""with b as (select o_orderpriority as p, month(o_orderdate) as band, 10 * log10(avg(o_totalprice * o_totalprice)) as db from orders group by 1, 2), l as (select *, max(db) over (partition by p) - 50 as low from b), c as (select p, band, db - avg(db) over (partition by p) as x from l where db >= low)
 select a.p as a, b.p as b, round(avg(abs(a.x - b.x)), 4) as distance from c a join c b on a.band = b.band and a.p < b.p group by 1, 2""")
def agg13_band_distance(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("p"), F.month("o_orderdate").alias("band")).agg((10 * F.log10(F.avg(F.col("o_totalprice") * F.col("o_totalprice")))).alias("db"))
    w = Window.partitionBy("p")
    c = b.withColumn("low", F.max("db").over(w) - 50).where("db >= low").withColumn("x", F.col("db") - F.avg("db").over(w))
    a, e = c.select(F.col("p").alias("a"), "band", F.col("x").alias("x0")), c.select(F.col("p").alias("b"), "band", F.col("x").alias("x1"))
    return a.join(e, "band").where("a < b").groupBy("a", "b").agg(r4(F.avg(F.abs(F.col("x0") - F.col("x1"))), "distance"))


@query("""with h as (select l_returnflag as part, l_linestatus as bar, l_quantity as l, l_extendedprice / 1000 as r from lineitem), s as (select part, bar, sqrt(avg(power((l - r) / 2, 2))) as side, sqrt(avg(power((l + r) / 2, 2))) as mid, sum(l * l) as el, sum(r * r) as er, max(abs((l + r) / 2)) as peak from h group by 1, 2)
 select part, bar, round(side / (mid + side), 4) as width, round((er - el) / (er + el), 4) as pan, round(20 * log10(peak / mid), 4) as crest from s""")
def agg22_width_crest(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("part"), F.col("l_linestatus").alias("bar"), F.col("l_quantity").alias("l"), (F.col("l_extendedprice") / 1000).alias("r"))
    m, s, l_, r_ = (F.col("l") + F.col("r")) / 2, (F.col("l") - F.col("r")) / 2, F.col("l"), F.col("r")
    g = h.groupBy("part", "bar").agg(F.sqrt(F.avg(s * s)).alias("side"), F.sqrt(F.avg(m * m)).alias("mid"), F.sum(l_ * l_).alias("el"), F.sum(r_ * r_).alias("er"), F.max(F.abs(m)).alias("peak"))
    return g.select("part", "bar", r4(F.col("side") / F.nullif(F.col("mid") + F.col("side"), F.lit(0.0)), "width"), r4((F.col("er") - F.col("el")) / F.nullif(F.col("er") + F.col("el"), F.lit(0.0)), "pan"), r4(20 * F.log10(F.col("peak") / F.nullif(F.col("mid"), F.lit(0.0))), "crest"))


@query("""with {ev}, f as (select user_id, cast(floor(t / 86400) as bigint) as day, ln(sum(value)) as y from ev group by 1, 2), s as (select user_id, regr_slope(y, day) as slope, count(*) as n from f group by 1)
 select cast(user_id % 5 as bigint) as grp, round(median(greatest(-slope, 0)), 4) as decay, count(*) as users from s where n >= 2 group by 1""")
def agg24_decay_fit(spark: SparkSession, d: str) -> DataFrame:
    f = events(spark, d).groupBy("user_id", F.floor(F.col("t") / 86400).alias("day")).agg(F.ln(F.sum("value")).alias("y"))
    s = f.groupBy("user_id").agg(F.regr_slope("y", "day").alias("slope"), F.count("*").alias("n")).where("n >= 2")
    return s.groupBy((F.col("user_id") % 5).alias("grp")).agg(r4(F.median(F.greatest(-F.col("slope"), F.lit(0.0))), "decay"), F.count("*").alias("users"))


@query("""with {ev}, f as (select user_id, cast(floor(t / 3600) as bigint) % 12 as pc, sum(value) as v from ev group by 1, 2), t as (select unnest(range(12)) as root, unnest(['major', 'minor']) as kind from range(1)),
 k as (select root, kind from (select unnest(range(12)) as root) cross join (select unnest(['major', 'minor']) as kind)), p as (select root, kind, unnest(case when kind = 'major' then [0, 4, 7] else [0, 3, 7] end) as step from k),
 d as (select user_id, root, kind, sum(v) / sqrt(3) as dot from f join p on f.pc = (root + step) % 12 group by 1, 2, 3), n as (select user_id, sqrt(sum(v * v)) as n from f group by 1),
 r as (select *, row_number() over (partition by user_id order by dot desc, root, kind) as rn from d join n using (user_id))
 select a.user_id, cast(a.root as bigint) as root, a.kind, round(a.dot / a.n, 4) as score, round(greatest(0, least(0.99, 0.5 + 3 * (a.dot - coalesce(b.dot, 0)) / a.n)), 4) as conf from r a left join r b on a.user_id = b.user_id and b.rn = 2 where a.rn = 1""".replace("t as (select unnest(range(12)) as root, unnest(['major', 'minor']) as kind from range(1)),\n ", ""))
def agg30_template(spark: SparkSession, d: str) -> DataFrame:
    f = events(spark, d).groupBy("user_id", (F.floor(F.col("t") / H) % 12).alias("pc")).agg(F.sum("value").alias("v"))
    shapes = [(r, k, (r + s) % 12) for r in range(12) for k, steps in (("major", (0, 4, 7)), ("minor", (0, 3, 7))) for s in steps]
    p = spark.createDataFrame(shapes, "root long, kind string, pc long")
    dots = f.join(F.broadcast(p), "pc").groupBy("user_id", "root", "kind").agg((F.sum("v") / F.sqrt(F.lit(3.0))).alias("dot"))
    n = f.groupBy("user_id").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("n"))
    two = series.top_k(dots, ["user_id"], [F.desc("dot"), F.col("root"), F.col("kind")], 2)
    g = two.groupBy("user_id").agg(F.min_by(F.struct("root", "kind", "dot"), "rank").alias("a"), F.max(F.when(F.col("rank") == 2, F.col("dot"))).alias("b"))
    margin = (F.col("a.dot") - F.coalesce("b", F.lit(0.0))) / F.col("n")
    return g.join(n, "user_id").select("user_id", "a.root", "a.kind", r4(F.col("a.dot") / F.col("n"), "score"), r4(F.greatest(F.lit(0.0), F.least(F.lit(0.99), 0.5 + 3 * margin)), "conf"))


@query("""with {ev}, b as (select user_id, cast(floor((t % 86400) / 21600) as bigint) as band, sum(value) as v from ev group by 1, 2), r as (select *, row_number() over (partition by user_id order by v desc, band) as rn from b), q as (select user_id, quantile_cont(value, 0.95) as p95, quantile_cont(value, 0.1) as p10 from ev group by 1)
 select user_id, band, round(v, 4) as v, round(p95, 4) as p95, round(p10, 4) as p10 from r join q using (user_id) where rn = 1""")
def agg33_dominant_band(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    b = e.groupBy("user_id", F.floor((F.col("t") % 86400) / 21600).alias("band")).agg(F.sum("value").alias("v"))
    top = series.top_k(b, ["user_id"], [F.desc("v"), F.col("band")], 1)
    q = e.groupBy("user_id").agg(r4(F.percentile("value", 0.95), "p95"), r4(F.percentile("value", 0.1), "p10"))
    return top.join(q, "user_id").select("user_id", "band", r4(F.col("v"), "v"), "p95", "p10")


@query("""select source, lang, count(*) as docs, cast(sum(len(string_split(text, ' '))) as bigint) as words, count(distinct text) as texts, max(n_chars) as longest from documents group by 1, 2""")
def agg34_summary(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy("source", "lang").agg(F.count("*").alias("docs"), F.sum(F.size(F.split("text", " "))).alias("words"), F.count_distinct("text").alias("texts"), F.max("n_chars").alias("longest"))
