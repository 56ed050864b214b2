"""Mixing sources to target weights by pivotal dependent rounding. DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, let, n_words

EPS = 1e-9


def source_targets(sources: DataFrame, *, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Adds weight and target to one row a source (source, n, source_size).

    Sources in code-point order, null last, take the weights in turn and share `share` of all sizes; no target is over
    cap times its source's size, what is above is shared again by weight. The fixed point is found at once: by rising
    size a weight, sources are capped as long as the rest's rate reaches their cap.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.array(*(F.lit(float(w)) for w in weights))[F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))]
    named = sources.withColumn("weight", weight).withColumn("most", cap * F.col("source_size"))
    by_rate = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = F.sum("source_size").over(Window.partitionBy())
    before = F.coalesce(F.sum("most").over(by_rate.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(by_rate.rowsBetween(0, Window.unboundedFollowing))
    rated = named.withColumn("rate", (share * everything - before) / rest).withColumn("capped", F.col("rate") >= F.col("most") / F.col("weight"))
    free = F.min(F.when(~F.col("capped"), F.struct(F.col("most") / F.col("weight"), F.col("source").isNull(), "source", "rate"))).over(Window.partitionBy())
    return rated.withColumn("target", F.when(F.col("capped"), F.col("most")).otherwise(free["rate"] * F.col("weight"))).drop("most", "rate", "capped")


def duel(a: Column, b: Column, seed: int) -> Column:
    """One pivotal step between units (row, key, size, p): mass, in words, moves until one probability is 0 or 1.

    The two moves' odds keep every unit's expected probability; the words of both together don't change.
    """
    up = F.least(1 - a["p"], b["p"] * b["size"] / a["size"])
    down = F.least(a["p"], (1 - b["p"]) * b["size"] / a["size"])
    chance = F.pmod(F.xxhash64(a["key"], b["key"], F.lit(seed)), F.lit(1 << 52)) / float(1 << 52)
    move = let(F.struct(up.alias("u"), down.alias("d"), chance.alias("c")), lambda m: F.when(m["c"] * (m["u"] + m["d"]) < m["d"], m["u"]).otherwise(-m["d"]))
    snap = lambda p: F.when(p < EPS, F.lit(0.0)).when(p > 1 - EPS, F.lit(1.0)).otherwise(p)
    return let(move, lambda m: F.struct(snap(a["p"] + m).alias("pa"), snap(b["p"] - m * a["size"] / b["size"]).alias("pb")))


def fold(units: Column, seed: int) -> Column:
    """Runs duels along an array of units: STRUCT(unit: the one left over, done: ARRAY of (row, up))."""
    unit = lambda u, p: F.struct(u["row"].alias("row"), u["key"].alias("key"), u["size"].alias("size"), p.alias("p"))
    won = lambda u, p: F.array(F.struct(u["row"].alias("row"), p.cast("int").alias("up")))
    whole = lambda p: (p == 0) | (p == 1)

    def step(s: Column, x: Column) -> Column:
        a = s["unit"]
        after = lambda r: F.when(whole(r["pa"]), F.struct(unit(x, r["pb"]).alias("unit"), F.concat(s["done"], won(a, r["pa"])).alias("done"))).otherwise(F.struct(unit(a, r["pa"]).alias("unit"), F.concat(s["done"], won(x, r["pb"])).alias("done")))
        met = let(duel(a, x, seed), after)
        return F.when(whole(a["p"]), F.struct(unit(x, x["p"]).alias("unit"), F.concat(s["done"], won(a, a["p"])).alias("done"))).otherwise(met)

    none = F.array().cast("array<struct<row:bigint,up:int>>")
    start = F.struct(unit(units[0], units[0]["p"]).alias("unit"), none.alias("done"))
    return F.aggregate(F.slice(units, 2, F.greatest(F.size(units) - 1, F.lit(0))), start, step)


def round_copies(units: DataFrame, scratch: Scratch, *, seed: int = 7, fan: int = 64) -> DataFrame:
    """(row, up): for units (source, n, row, key, size, p) whether a unit gets a copy more than its whole part.

    A reduction tree: units meet by key in groups of about fan within their source; each group's duels settle all but
    one unit, and these meet on the next level. The last unit of a source goes to the nearer whole number, so a
    source's words miss its target by half a document at most.
    """
    groups = F.ceil(F.col("n") / fan)
    now = units.select("source", "row", "key", "size", "p", F.pmod(F.xxhash64("key"), groups).alias("node"))
    crowd = scratch.table(now.groupBy("source", "node").agg(F.count("*").alias("c")).where(F.col("c") > 4 * fan), "crowd")
    crowd = crowd.withColumnRenamed("source", "_s").withColumnRenamed("node", "_n")
    # many equal rows share a key: their groups are split by row
    now = now.join(crowd, F.col("source").eqNullSafe(F.col("_s")) & (F.col("node") == F.col("_n")), "left").withColumn("part", F.when(F.col("c").isNull(), 0).otherwise(F.pmod("row", F.ceil(F.col("c") / fan)))).select("source", "node", "part", "row", "key", "size", "p")
    done, level = [], 0
    while True:
        meeting = F.sort_array(F.collect_list(F.struct("key", "row", "size", "p")))
        folded = now.groupBy("source", "node", "part").agg(fold(meeting, seed).alias("f"))
        folded = scratch.table(folded.select("source", "node", "part", "f.unit", "f.done"), f"level{level}")
        done.append(folded.select(F.explode("done").alias("d")).select("d.row", "d.up"))
        rest = folded.select("source", "node", "part", "unit.*")
        most = rest.agg(F.max("node").alias("a"), F.max("part").alias("b")).first()
        if not most["a"] and not most["b"]:
            done.append(rest.select("row", F.when(F.col("p") >= 0.5, 1).otherwise(0).alias("up")))
            break
        split = bool(most["b"])
        now = rest.select("source", F.col("node") if split else F.floor(F.col("node") / fan).alias("node"), F.floor(F.col("part") / fan).alias("part"), "row", "key", "size", "p")
        level += 1
    out = done[0]
    for x in done[1:]:
        out = out.union(x)
    return out


def mix_plan(sized: DataFrame, scratch: Scratch, *, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: int = 7, fan: int = 64) -> DataFrame:
    """(row, source_size, target, copies) for a written table (row, key, source, size)."""
    sources = sized.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("source_size"))
    sources = scratch.table(source_targets(sources, weights=weights, share=share, cap=cap), "sources").withColumnRenamed("source", "_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(rate + EPS)
    part = F.when(rate - whole > EPS, rate - whole).otherwise(0.0)
    rated = sized.join(sources, F.col("source").eqNullSafe(F.col("_source"))).withColumn("whole", whole).withColumn("p", part)
    ups = round_copies(rated.where("p > 0 and size > 0"), scratch, seed=seed, fan=fan)
    ups = scratch.table(ups.withColumnRenamed("row", "_row"), "ups")
    return rated.join(ups, F.col("row") == F.col("_row"), "left").select("row", "id", "size", "source_size", "target", (F.col("whole") + F.coalesce("up", F.lit(0))).cast("long").alias("copies"))


def sized_docs(docs: DataFrame, id_col: str, text_col: str, source_col: str, *more: Column) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.monotonically_increasing_id().alias("row"), F.xxhash64(F.col(id_col), text).alias("key"), F.col(id_col).alias("id"), F.col(source_col).alias("source"), n_words(text).alias("size"), *more)


def mix(docs: DataFrame, spark: SparkSession, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """Per row of docs: id, size (words), source_size, target and taken (words that the mix takes).

    A row gets the whole part of target / source_size copies, or one more; which, pivotal rounding settles, so the words
    taken of a source are its target but for half a document. Rows without words take nothing. A null source is one
    more source, the last. The same rows give the same mix (rows equal in all that is read may swap their shares).
    """
    scratch = Scratch(spark, "mix")
    sized = scratch.table(sized_docs(docs, id_col, text_col, source_col), "sized")
    plan = mix_plan(sized, scratch, **how)
    return plan.select(F.col("id").alias(id_col), "size", F.col("source_size").cast("long").alias("source_size"), "target", (F.col("copies") * F.col("size")).alias("taken"))


def take(docs: DataFrame, spark: SparkSession, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The mixed rows themselves, each as often as the mix takes it, with all columns of docs. Wordless rows go."""
    scratch = Scratch(spark, "take")
    whole = scratch.table(sized_docs(docs, id_col, text_col, source_col, F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc")), "whole")
    copies = scratch.table(mix_plan(whole.select("row", "key", "id", "source", "size"), scratch, **how).where("copies > 0 and size > 0").select(F.col("row").alias("_row"), "copies"), "copies")
    # always a merge join: the plan decides over as many rows as there are documents, so it is never a small side
    return whole.select("row", "doc").join(copies.hint("merge"), F.col("row") == F.col("_row")).select("doc", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("doc.*")
