"""Order-dependent folds that no window expresses, over bounded stretches."""

from __future__ import annotations

from itertools import chain, count

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .joins import clusters, sweep


def _typed(df: DataFrame, *more: str) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), *more])


def monophonic(df: DataFrame, by: list[str], start: str, end: str, pitch: str, reach: float) -> DataFrame:
    """Rows of a key without overlaps, taken by start, end and pitch: of two that sound at once the one nearer to the key's
    median pitch stays (the earlier one if both are as near), cut where the next begins; rows that this leaves empty go.
    `reach` bounds a row's length, so stretches further apart are dealt each for itself; a task holds one row of each."""
    median = df.groupBy(*by).agg(F.median(pitch).alias("_mid"))
    cols = [*df.columns]
    give = lambda row, out: out.append(tuple(row[c] for c in cols)) if row[end] > row[start] else None

    def step(state: dict, row: dict, out: list) -> None:
        last = state.get("last")
        if last is not None and row[start] < last[end] - 1e-6:
            if abs(row[pitch] - row["_mid"]) >= abs(last[pitch] - row["_mid"]):
                return
            last[end] = row[start]
        if last is not None:
            give(last, out)
        state["last"] = row

    def finish(key: tuple, state: dict, out: list) -> None:
        give(state["last"], out)

    placed = clusters(df.join(median, by), by, start, reach)
    return sweep(placed, [*by, "_cluster"], [start, end, pitch], _typed(df), step, finish)


def segments(df: DataFrame, by: list[str], start: str, end: str, first: float, last: float, longest: float, rest: float = 0.3, least: float = 1.0) -> DataFrame:
    """(by, segment, a, b): spans that cover [first, last), cut between a key's notes: in the middle of a rest of `rest` once
    half of `longest` is full, else, when a note would reach beyond `longest`, in the middle of the widest rest so far that
    leaves `least` (the later of equal ones), else hard at `longest`. A span that is still longer is cut into pieces of
    `longest`. One pass by start that holds the note before and the widest rest."""
    schema = _typed(df.select(*by), "segment long", "a double", "b double")

    def give(key: tuple, state: dict, b: float, out: list) -> None:
        a = state["at"]
        while b - a > longest:
            out.append((*key, state["n"], a, a + longest))
            a, state["n"] = a + longest, state["n"] + 1
        out.append((*key, state["n"], a, b))
        state.update(at=b, n=state["n"] + 1, best=None)

    def step(state: dict, row: dict, out: list) -> None:
        if not state:
            state.update(at=first, n=0, best=None, before=row[end])
            return
        middle, gap = (state["before"] + row[start]) / 2, row[start] - state["before"]
        state["before"] = row[end]
        key = tuple(row[k] for k in by)
        if gap >= rest and middle - state["at"] >= longest / 2:
            give(key, state, middle, out)
            return
        if middle - state["at"] > least and (state["best"] is None or gap >= state["best"][0]):
            state["best"] = (gap, middle)
        if row[end] - state["at"] > longest:
            give(key, state, state["best"][1] if state["best"] else state["at"] + longest, out)

    def finish(key: tuple, state: dict, out: list) -> None:
        give(key, state, last, out)

    notes = df.where((F.col(end) > first) & (F.col(start) < last)).select(*by, F.col(start).cast("double"), F.col(end).cast("double"))
    return sweep(notes, by, [start, end], schema, step, finish)


def spaced_peaks(df: DataFrame, by: list[str], on: str, strength: str, least: float) -> DataFrame:
    """Peaks at least `least` apart, stronger ones first, earlier ones of equal ones. Peaks that no gap of `least` parts are one group."""

    cols = [*df.columns]

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        taken: list[float] = []
        keep = []
        for row in pdf.sort_values([strength, on], ascending=[False, True]).itertuples():
            t = getattr(row, on)
            if all(abs(t - x) >= least for x in taken):
                taken.append(t)
                keep.append(row.Index)
        return pdf.loc[keep, cols]

    return clusters(df, by, on, least).groupBy(*by, "_cluster").applyInPandas(fold, df.schema)


def unique_names(df: DataFrame, by: list[str], name: str, stem: str, order: str) -> DataFrame:
    """Names made unique in order, within `by`: `name`, else `name.stem`, else that with 2, 3 and so on, the first that no row
    before it has, made or given. A pass that holds the names of one `by`."""

    def step(state: dict, row: dict, out: list) -> None:
        taken = state.setdefault("taken", set())
        full = f"{row[name]}.{row[stem]}"
        every = chain((row[name], full), (f"{full}{n}" for n in count(2)))
        new = next(x for x in every if x not in taken)
        taken.add(new)
        out.append((*(row[c] for c in cols), new))

    cols = [*df.columns]
    return sweep(df, by, [order], _typed(df, "unique string"), step, lambda key, state, out: None)
