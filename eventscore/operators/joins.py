"""Joins over time: tolerance, as-of, nearest, overlap, one-to-one matching. All keep equi keys, so none is a cross join."""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def range_join(left: DataFrame, right: DataFrame, by: list[str], lcol: str, rcol: str, tolerance: float) -> DataFrame:
    """Pairs with equal `by` and |lcol - rcol| <= tolerance. Rows meet in buckets of the tolerance's width, the right side in three."""
    l_ = left.withColumn("_b", F.floor(F.col(lcol) / tolerance))
    near = F.array(*(F.floor(F.col(rcol) / tolerance) + k for k in (-1, 0, 1)))
    r_ = right.withColumn("_b", F.explode(near))
    return l_.join(r_, [*by, "_b"]).where(F.abs(F.col(lcol) - F.col(rcol)) <= tolerance).drop("_b")


def asof_join(left: DataFrame, right: DataFrame, by: list[str], on: str, value: Column, name: str, *, forward: bool = False, strict: bool = False) -> DataFrame:
    """left with the last (forward: next) value of right at or before (strict: before) its `on`, within `by`; one sort, no pairs."""
    l_ = left.withColumn("_side", F.lit(1 if not strict else 0)).withColumn("_v", F.lit(None).cast(right.select(value).schema[0].dataType))
    r_ = right.select(*by, on, value.alias("_v"), F.lit(0 if not strict else 1).alias("_side"))
    both = l_.unionByName(r_, allowMissingColumns=True).withColumn("_left", F.col("_side") == (1 if not strict else 0))
    order = [F.col(on).desc(), F.col("_side")] if forward else [F.col(on), F.col("_side")]
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn(name, F.last("_v", ignorenulls=True).over(w)).where("_left").drop("_side", "_v", "_left")


def nearest_join(left: DataFrame, right: DataFrame, by: list[str], on: str, key: str, name: str) -> DataFrame:
    """left with the key and distance of the nearest row of right within `by`; ties: the earlier one."""
    pair = F.struct(F.col(on).alias("at"), F.col(key).alias("key"))
    back = asof_join(left, right, by, on, pair, "_back")
    both = asof_join(back, right, by, on, pair, "_ahead", forward=True)
    d0, d1 = F.col(on) - F.col("_back.at"), F.col("_ahead.at") - F.col(on)
    first = F.col("_ahead").isNull() | (d0 <= d1)
    return both.withColumn(name, F.when(first, F.col("_back.key")).otherwise(F.col("_ahead.key"))).withColumn(f"{name}_distance", F.when(first, d0).otherwise(d1)).drop("_back", "_ahead")


def overlap_join(left: DataFrame, right: DataFrame, by: list[str], width: float, least: float = 0.0) -> DataFrame:
    """Pairs of intervals left [a0, b0) and right [a1, b1) within `by` that share more than `least`, with the piece [a, b).

    Intervals enter every bucket of `width` that they touch; a pair counts in the bucket where its piece begins.
    """

    def cut(df: DataFrame, a: str, b: str) -> DataFrame:
        return df.where(F.col(b) > F.col(a)).withColumn("_b", F.explode(F.sequence(F.floor(F.col(a) / width), F.floor(F.col(b) / width))))

    pairs = cut(left, "a0", "b0").join(cut(right, "a1", "b1"), [*by, "_b"])
    pairs = pairs.withColumn("a", F.greatest("a0", "a1")).withColumn("b", F.least("b0", "b1"))
    return pairs.where((F.col("b") - F.col("a") > least) & (F.floor(F.col("a") / width) == F.col("_b"))).drop("_b")


def clusters(df: DataFrame, by: list[str], on: str, gap: float) -> DataFrame:
    """Adds `_cluster`: rows of a key that no gap over `gap` parts. Matches with that tolerance never cross clusters."""
    w = Window.partitionBy(*by).orderBy(on)
    return df.withColumn("_new", F.coalesce((F.col(on) - F.lag(on).over(w) > gap).cast("int"), F.lit(0))).withColumn("_cluster", F.sum("_new").over(w.rangeBetween(Window.unboundedPreceding, 0))).drop("_new")


def most_pairs(links: list[list[int]], n_right: int) -> int:
    """Size of a maximum matching of a bipartite graph, by augmenting paths along depth-first searches without recursion."""
    mate_left, mate_right = [-1] * len(links), [-1] * n_right
    for root in range(len(links)):
        seen: set[int] = set()
        path = [(root, iter(links[root]))]
        came: list[int] = []
        while path:
            v = next((x for x in path[-1][1] if x not in seen), None)
            if v is None:
                path.pop()
                if came:
                    came.pop()
                continue
            seen.add(v)
            came.append(v)
            if mate_right[v] < 0:
                for (u, _), w in zip(path, came, strict=True):
                    mate_left[u], mate_right[w] = w, u
                break
            path.append((mate_right[v], iter(links[mate_right[v]])))
    return sum(x >= 0 for x in mate_left)


def sweep(df: DataFrame, keys: list[str], order: list[str], schema: str, step, end) -> DataFrame:
    """Runs step(state, row, out) over each key's rows in order, then end(key, state, out); state is a dict that starts empty,
    out takes rows of schema. Rows are dealt by keys, sorted, and stream through: a task holds one state and one batch."""
    cols = [*df.columns]
    dealt = df.repartition(*keys).sortWithinPartitions(*keys, *order)

    def run(batches):
        now, state = None, {}
        for pdf in batches:
            out: list[tuple] = []
            for row in pdf.itertuples(index=False, name=None):
                row = dict(zip(cols, row, strict=True))
                key = tuple(row[k] for k in keys)
                if key != now:
                    if now is not None:
                        end(now, state, out)
                    now, state = key, {}
                step(state, row, out)
            if out:
                yield pd.DataFrame(out, columns=names)
        out = []
        if now is not None:
            end(now, state, out)
        if out:
            yield pd.DataFrame(out, columns=names)

    names = [x.strip().split(" ")[0].strip("`") for x in schema.split(", ")]
    return dealt.mapInPandas(run, schema)


def match_counts(left: DataFrame, right: DataFrame, by: list[str], on: str, tolerance: float, other: str | None = None, other_tolerance: float = 0.0) -> DataFrame:
    """Per key: n_left, n_right, n_matched, f1 of a one-to-one matching within the tolerance(s).

    No match crosses a cluster, so clusters are dealt each for itself, and those with one side alone not at all. On a
    line each row takes the earliest open partner, in one pass that holds what lies within the tolerance. With a second
    tolerance a cluster's links, found within the tolerance of the sorted rows, go through augmenting paths.
    """
    cols = [*by, on] + ([other] if other else [])
    both = left.select(*cols, F.lit(True).alias("_l")).unionByName(right.select(*cols, F.lit(False).alias("_l")))
    both = clusters(both, by, on, tolerance)
    mixed = F.min("_l").over(Window.partitionBy(*by, "_cluster")) != F.max("_l").over(Window.partitionBy(*by, "_cluster"))
    sides = both.groupBy(*by).agg(F.count_if("_l").alias("n_left"), F.count_if(~F.col("_l")).alias("n_right"))
    both = both.withColumn("_mixed", mixed).where("_mixed").drop("_mixed")
    schema = ", ".join([*(f"`{k}` {both.schema[k].dataType.simpleString()}" for k in by), "m long"])

    def step(state: dict, row: dict, out: list) -> None:
        mine, theirs = state.setdefault(row["_l"], deque()), state.setdefault(not row["_l"], deque())
        if other is None:
            while theirs and row[on] - theirs[0] > tolerance:
                theirs.popleft()
            if theirs:
                theirs.popleft()
                state["m"] = state.get("m", 0) + 1
            else:
                mine.append(row[on])
            return
        state.setdefault("links", [])
        state["n"] = state.get("n", 0)
        at = (row[on], row[other], len(state["links"]) if row["_l"] else state["n"])
        if row["_l"]:
            state["links"].append([])
        else:
            state["n"] += 1
        mine.append(at)
        while theirs and row[on] - theirs[0][0] > tolerance:
            theirs.popleft()
        for _, v, i in theirs:
            if abs(v - row[other]) <= other_tolerance:
                state["links"][at[2] if row["_l"] else i].append(i if row["_l"] else at[2])

    def end(key: tuple, state: dict, out: list) -> None:
        out.append((*key[:-1], state.get("m", 0) if other is None else most_pairs(state["links"], state["n"])))

    found = sweep(both, [*by, "_cluster"], [on, "_l"], schema, step, end).groupBy(*by).agg(F.sum("m").alias("n_matched"))
    every = sides.join(found, by, "left").na.fill(0, ["n_matched"])
    return every.withColumn("f1", 2.0 * F.col("n_matched") / (F.col("n_left") + F.col("n_right")))
