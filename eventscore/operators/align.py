"""Alignment of word sequences: matching blocks, word error rate, best offset."""

from __future__ import annotations

from collections.abc import Sequence
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def blocks(a: Sequence[str], b: Sequence[str]) -> list[tuple[int, int, int]]:
    """(i, j, n) of the common runs, longest first and then on both sides of it (Ratcliff-Obershelp, no junk rule)."""
    return [tuple(m) for m in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks() if m.size]


def word_distance(a: Sequence[str], b: Sequence[str]) -> int:
    """Levenshtein distance in words."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def _wer(ref: pd.Series, hyp: pd.Series) -> pd.Series:
    """Word error rate of two arrays of words; without a reference 1 if anything was heard, else 0."""

    def one(r, h):
        r, h = list(r) if r is not None else [], list(h) if h is not None else []
        return word_distance(r, h) / len(r) if r else float(bool(h))

    return pd.Series([one(r, h) for r, h in zip(ref, hyp, strict=True)])


def _similarity(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """Words in common runs, the longest run, and twice the first over all words."""
    out = []
    for x, y in zip(a, b, strict=True):
        x, y = list(x) if x is not None else [], list(y) if y is not None else []
        m = blocks(x, y)
        n = sum(k for _, _, k in m)
        out.append((n, max((k for _, _, k in m), default=0), 2 * n / (len(x) + len(y)) if len(x) + len(y) else 1.0))
    return pd.DataFrame(out, columns=["matched", "longest", "ratio"])


def _reconcile(ref: pd.Series, heard: pd.Series, starts: pd.Series) -> pd.Series:
    """The reference's words with times: those matched take the heard start, runs between two take even shares of the gap,
    a run at the start steps back 0.4 a word, a run at the end is dropped."""

    def one(r, h, t):
        r, h, t = list(r), list(h), list(t)
        at = {i + k: j + k for i, j, n in blocks(r, h) for k in range(n)}
        known, out = sorted(at), []
        for i, w in enumerate(r):
            if i in at:
                out.append({"i": i, "word": w, "heard": h[at[i]], "at": float(t[at[i]])})
                continue
            before, after = max((k for k in known if k < i), default=None), min((k for k in known if k > i), default=None)
            if after is None:
                continue
            stop = float(t[at[after]])
            when = stop - 0.4 * (after - i) if before is None else float(t[at[before]]) + (stop - float(t[at[before]])) * (i - before) / (after - before)
            out.append({"i": i, "word": w, "heard": None, "at": when})
        return out

    return pd.Series([one(*x) for x in zip(ref, heard, starts, strict=True)])


def tokens(c: Column) -> Column:
    return F.filter(F.transform(F.split(F.lower(c), "\\s+"), lambda w: F.btrim(F.regexp_replace(w, "[^a-z0-9']", ""), F.lit("'"))), lambda w: w != "")


def wer(ref: Column, hyp: Column) -> Column:
    return F.pandas_udf(_wer, "double")(ref, hyp)


def similarity(a: Column, b: Column) -> Column:
    return F.pandas_udf(_similarity, "matched long, longest long, ratio double")(a, b)


def reconcile(ref: Column, heard: Column, starts: Column) -> Column:
    return F.pandas_udf(_reconcile, "array<struct<i:int,word:string,heard:string,at:double>>")(ref, heard, starts)


def _matched(a: pd.Series, b: pd.Series) -> pd.Series:
    """Places (i, j) of the words that two arrays agree on."""
    return pd.Series([[{"i": i + k, "j": j + k} for i, j, n in blocks(list(x), list(y)) for k in range(n)] if x is not None and y is not None else [] for x, y in zip(a, b, strict=True)])


def matched(a: Column, b: Column) -> Column:
    return F.pandas_udf(_matched, "array<struct<i:int,j:int>>")(a, b)
