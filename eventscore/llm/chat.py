"""Chat formatting: a dialogue of several speakers, once from each speaker's side, with masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def label(role: Column) -> Column:
    """How a participant is named: the role itself where it is made of letters, digits, - and _; else with _ for other
    characters and the role's bytes in hexadecimal behind it. Different roles never share a label, null is `unknown_`."""
    role = role.cast("string")
    plain = role.rlike("^[\\p{L}\\p{N}_-]+$") & ~role.rlike("_[0-9A-F]*$")
    shown = F.regexp_replace(F.coalesce(role, F.lit("unknown")), "[^\\p{L}\\p{N}_-]", "_")
    return F.when(plain, role).otherwise(F.concat(shown, F.lit("_"), F.coalesce(F.hex(F.encode(role, "UTF-8")), F.lit(""))))


def positions(turns: DataFrame, spark: SparkSession, scratch: Scratch) -> DataFrame:
    """Adds pos, a row's place in its conversation by turn, role and text, to rows (conv, lone, turn, role, text).

    Rows are dealt by ranges of all of them, so a conversation of any length spreads over partitions; its rows in earlier
    partitions are counted, never gathered.
    """
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col("conv").asc_nulls_first(), F.col("lone").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("tie").asc()]
    ordered = turns.withColumn("tie", F.xxhash64("text")).repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    ordered = scratch.table(ordered.select("conv", "lone", "turn", "role", "text", F.monotonically_increasing_id().alias("at")), "ordered")
    part = F.shiftright("at", 33)
    runs = ordered.groupBy("conv", "lone", part.alias("part")).agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("conv", "lone").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = scratch.table(runs.select(F.col("conv").alias("_conv"), F.col("lone").alias("_lone"), F.col("part").alias("_part"), (before - F.col("first")).alias("_shift")), "runs")
    same = F.col("conv").eqNullSafe(F.col("_conv")) & F.col("lone").eqNullSafe(F.col("_lone")) & (part == F.col("_part"))
    return ordered.join(runs, same).select("conv", "lone", "turn", "role", "text", (F.col("at") + F.col("_shift")).alias("pos"))


def rotate(turns: DataFrame, spark: SparkSession, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", part_turns: int = 256, context_turns: int = 16) -> DataFrame:
    """One row per conversation, speaker and part: id, speaker, part, n_turns, n_context, text, masks, masked_chars.

    The speaker's turns are rendered as `assistant`, all others' as `user name=...`; masks lists the ranges `start-end`
    of the text, in characters, that are learned: the speaker's words with their end mark. Marks inside a text are
    broken by a blank. Participants are told apart by their roles as they are; label says how they are written. A part
    holds part_turns turns at most, so a dialogue of any length needs bounded memory; a longer one goes on in the next
    part, behind the context_turns turns before it, which are shown and never masked, so every turn is learned once. In
    a part a speaker may have no turn of its own (masks is then empty).

    A null role is a participant, apart from one called `unknown`. Null text: an empty turn. A row without conversation
    id belongs to no known dialogue and is one by itself. Turns come by number (null first); ties by role and then by a
    hash of the text; repeated rows are repeated turns.
    """
    scratch = Scratch(spark, "chat")
    said = F.regexp_replace(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "<\\|", "< |")
    lone = F.when(F.col(id_col).isNull(), F.monotonically_increasing_id())
    src = scratch.table(turns.select(F.col(id_col).alias("conv"), lone.alias("lone"), F.col(turn_col).alias("turn"), label(F.col(role_col)).alias("role"), said.alias("text")), "turns")
    placed = scratch.table(positions(src, spark, scratch), "placed")
    speakers = scratch.table(placed.select("conv", "lone", F.col("role").alias("speaker")).distinct(), "speakers").withColumnRenamed("conv", "_conv").withColumnRenamed("lone", "_lone")
    part = F.floor(F.col("pos") / part_turns)
    here = F.struct(part.alias("part"), F.lit(True).alias("own"))
    seen = F.when(F.pmod("pos", F.lit(part_turns)) >= part_turns - context_turns, F.array(here, F.struct((part + 1).alias("part"), F.lit(False).alias("own")))).otherwise(F.array(here))
    dealt = placed.withColumn("x", F.explode(seen)).select("conv", "lone", "x.part", "x.own", "pos", "role", "text")
    parts = dealt.groupBy("conv", "lone", "part").agg(F.sort_array(F.collect_list(F.struct("pos", "role", "text", "own"))).alias("turns"), F.count_if("own").alias("n")).where("n > 0")
    parts = scratch.table(parts, "parts")
    each = parts.join(speakers, F.col("conv").eqNullSafe(F.col("_conv")) & F.col("lone").eqNullSafe(F.col("_lone"))).select("conv", "part", "turns", "n", "speaker")

    def head(role: Column) -> Column:
        return F.concat(F.lit(OPEN), F.when(role == F.col("speaker"), F.lit("assistant")).otherwise(F.concat(F.lit("user name="), role)), F.lit("\n"))

    rendered = F.array_join(F.transform("turns", lambda t: F.concat(head(t["role"]), t["text"], F.lit(f"{CLOSE}\n"))), "")
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("spans"), F.lit(0).cast("long").alias("chars"))

    def step(s: Column, t: Column) -> Column:
        start = s["at"] + F.length(head(t["role"]))
        end = start + F.length(t["text"]) + len(CLOSE)
        own = (t["role"] == F.col("speaker")) & t["own"]
        return F.struct((end + 1).cast("long").alias("at"), F.when(own, F.concat(s["spans"], F.array(F.concat_ws("-", start.cast("string"), end.cast("string"))))).otherwise(s["spans"]).alias("spans"), F.when(own, s["chars"] + (end - start)).otherwise(s["chars"]).cast("long").alias("chars"))

    marked = each.withColumn("m", F.aggregate("turns", zero, step))
    context = (F.size("turns") - F.col("n")).cast("long")
    return marked.select(F.col("conv").alias(id_col), "speaker", F.col("part").cast("long").alias("part"), F.col("n").alias("n_turns"), context.alias("n_context"), rendered.alias("text"), F.array_join("m.spans", ",").alias("masks"), F.col("m.chars").alias("masked_chars"))


def rotate_sql(part_turns: int = 256, context_turns: int = 16) -> str:
    """rotate() over `conversations` as SQL for DuckDB, where ids are known and turns are numbered without ties."""
    return f"""
    with t as (select conv_id, turn, case when regexp_matches(role, '^[\\p{{L}}\\p{{N}}_-]+$') and not regexp_matches(role, '_[0-9A-F]*$') then role
        else regexp_replace(coalesce(role, 'unknown'), '[^\\p{{L}}\\p{{N}}_-]', '_', 'g') || '_' || coalesce(hex(encode(role)), '') end as role, replace(coalesce(text, ''), '<|', '< |') as text from conversations),
    n as (select *, row_number() over (partition by conv_id order by turn nulls first, role) - 1 as pos, count(*) over (partition by conv_id) as size from t),
    p as (select *, pos // {part_turns} as part, true as here from n union all select *, pos // {part_turns} + 1, false from n where pos % {part_turns} >= {part_turns - context_turns} and (pos // {part_turns} + 1) * {part_turns} < size),
    s as (select distinct conv_id, role as speaker from t),
    h as (select p.conv_id, speaker, part, pos, here, p.role = speaker and here as own, text,
        '{OPEN}' || case when p.role = speaker then 'assistant' else 'user name=' || p.role end || chr(10) as head from p join s on p.conv_id is not distinct from s.conv_id),
    o as (select *, coalesce(sum(length(head) + length(text) + {len(CLOSE) + 1}) over (partition by conv_id, speaker, part order by pos rows between unbounded preceding and 1 preceding), 0) + length(head) as start from h)
    select conv_id, speaker, cast(part as bigint) as part, count(*) filter (where here) as n_turns, count(*) filter (where not here) as n_context, string_agg(head || text || '{CLOSE}' || chr(10), '' order by pos) as text,
        coalesce(string_agg(cast(cast(start as bigint) as varchar) || '-' || cast(cast(start + length(text) + {len(CLOSE)} as bigint) as varchar), ',' order by pos) filter (where own), '') as masks,
        cast(coalesce(sum(length(text) + {len(CLOSE)}) filter (where own), 0) as bigint) as masked_chars
    from o group by conv_id, speaker, part"""
