"""Words, labels and event lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def normal_word(w: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(w), "[^a-z0-9']", ""), F.lit("'"))


def heard_words(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """One row a normalised word; hyphens part words, empty words go."""
    return df.select(*keep, F.explode(F.split(F.regexp_replace(F.lower(text), "-", " "), " ")).alias("_w")).select(*keep, normal_word(F.col("_w")).alias("word")).where("word <> ''")


def word_counts(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """(keep, word, n): raw tokens are counted first, so each different one is normalised once a key."""
    raw = df.select(*keep, F.explode(F.split(F.lower(text), "[- ]")).alias("_w")).groupBy(*keep, "_w").agg(F.count("*").alias("_n"))
    return raw.withColumn("word", normal_word(F.col("_w"))).where("word <> ''").groupBy(*keep, "word").agg(F.sum("_n").alias("n"))


def slug(c: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), F.lit("")), F.lit("run"))


def minutes(seconds: Column, *, signed: bool = False) -> Column:
    """`m:ss`; nothing below `0:00`, and `?` for null, unless signed: then the numbers as they are."""
    s = seconds if signed else F.greatest(seconds, F.lit(0.0))
    at = F.concat(F.floor(s / 60).cast("string"), F.lit(":"), F.lpad((F.floor(s) % 60).cast("string"), 2, "0"))
    return at if signed else F.coalesce(at, F.lit("?"))


def delta(x: Column) -> Column:
    """`(+13)`, the sign from the rounded value, never `-0`; half to even."""
    n = F.rint(x).cast("long")
    return F.concat(F.lit("("), F.when(n >= 0, "+").otherwise(""), n.cast("string"), F.lit(")"))


def parse_event_line(df: DataFrame, line: str) -> DataFrame:
    """`bar:beat atom vel` lines to columns; what doesn't fit is null."""
    shape = "^([0-9]+):([0-9.]+) (\\S+)(?: ([0-9]+))?$"
    part = lambda g: F.regexp_extract(line, shape, g)
    return df.withColumn("bar", part(1).try_cast("long")).withColumn("beat", part(2).try_cast("double")).withColumn("atom", F.nullif(part(3), F.lit(""))).withColumn("vel", part(4).try_cast("long"))
