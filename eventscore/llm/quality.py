"""Quality rules: base counts of a text, and lines that too many documents of one host share. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, let, words

SYMBOLS = "#*$%&|<>"


def repeated_words(w: Column) -> Column:
    """How many words of an array lie in 3-word windows found twice or more in it. Windows are compared by 64-bit hashes."""

    def cover(h: Column) -> Column:
        ranked = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        again = lambda s: F.filter(s, lambda e, j: ((j > 0) & (F.get(s, j - 1)["x"] == e["x"])) | ((j < F.size(s) - 1) & (F.get(s, j + 1)["x"] == e["x"])))
        at = let(ranked, lambda s: F.sort_array(F.transform(again(s), lambda e: e["i"])))
        steps = let(at, lambda p: F.transform(p, lambda v, j: F.when(j + 1 < F.size(p), F.least(F.lit(3), F.get(p, j + 1) - v)).otherwise(F.lit(3))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    hashes = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    some = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(cover(h)))
    return F.when(F.size(w) < 3, F.lit(0)).otherwise(some)


def base_counts(text: Column) -> Column:
    """STRUCT of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (longs) of a whole text; null counts as empty."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    full = F.filter(F.split(t, "\n", -1), lambda x: F.rlike(x, F.lit("[^\\x20\\x09-\\x0D]")))
    of_words = let(words(t), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), repeated_words(w).cast("long").alias("n_repeat_words")))
    of_lines = let(full, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))
    symbols = F.regexp_count(t, F.lit(f"[{SYMBOLS}]")).cast("long")
    return let(of_words, lambda a: F.struct(a["n_words"].alias("n_words"), a["word_chars"].alias("word_chars"), symbols.alias("n_symbols"), of_lines.alias("n_dup_lines"), a["n_repeat_words"].alias("n_repeat_words")))


def base_failed(c: Column) -> Column:
    return (c["n_words"] < 50) | (100 * c["n_repeat_words"] > 50 * c["n_words"])


def normal_line(x: Column) -> Column:
    """A line as it is compared: lower case, letters only, other characters one space."""
    return F.trim(F.regexp_replace(F.lower(x), "[^\\p{L}]+", " "))


def _keys(host: Column, text: Column) -> list[Column]:
    """128 bits that stand for a host and a text."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    return [F.xxhash64(host, t).alias("k1"), F.xxhash64(F.lit("2"), t, host).alias("k2")]


def shared_lines(docs: DataFrame, spark: SparkSession, *, text_col: str = "text", host_col: str = "source", min_docs: int = 10, depleted_share: float = 0.5) -> DataFrame:
    """Per different document of a host with lines to remove: (k1, k2: its keys, n, lines: their hashes, depleted).

    A document's different normalised lines are hashed with its host and counted, with partial sums, over all different
    documents of the host: rows with the same host and text are one document, so a text is never cut for having copies.
    A line of more than min_docs documents, at hosts of every size, is removed from all of them. A document is depleted
    if the removed lines hold more than depleted_share of the letters of its different lines.

    Ids play no part. A null host is a host of its own, a null text has no lines. The limits reach the documents by a
    join that Spark broadcasts only below its threshold of the written table's size, and else sorts on both sides.
    """
    scratch = Scratch(spark, "quality")
    src = docs.select(F.col(host_col).alias("host"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    whole = F.split(F.regexp_replace(F.lower("text"), "[^\\p{L}\\n]+", " "), "\n", -1)
    lines = F.array_distinct(F.filter(F.transform(whole, lambda x: F.trim(x)), lambda x: x != ""))
    hashed = F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("h"), F.length(x).alias("size")))
    docs_lines = scratch.table(src.select(F.monotonically_increasing_id().alias("row"), F.xxhash64("host").alias("host"), *_keys(F.col("host"), F.col("text")), hashed.alias("lines")), "lines")
    twins = docs_lines.groupBy("k1", "k2").agg(F.min("row").alias("first"), F.count("*").alias("n")).where("n > 1").select("k1", "k2", "first")
    again = scratch.table(docs_lines.select("row", "k1", "k2").join(scratch.table(twins, "twins"), ["k1", "k2"]).where("row <> first").select("row"), "again")
    total = F.aggregate("lines", F.lit(0).cast("long"), lambda a, x: a + x["size"])
    each = docs_lines.join(again, "row", "left_anti").select("host", "k1", "k2", total.alias("total"), F.explode("lines").alias("x")).select("host", "k1", "k2", "total", "x.h", "x.size")
    often = scratch.table(each.groupBy("host", "h").agg(F.count("*").alias("n")).where(F.col("n") > min_docs).select("host", "h"), "often")
    gone = each.join(often, ["host", "h"])
    cut = gone.groupBy("k1", "k2").agg(F.sum("size").alias("size"), F.max("total").alias("total"), F.collect_set("h").alias("lines"))
    return scratch.table(cut.select("k1", "k2", F.size("lines").cast("long").alias("n"), "lines", (F.col("size") > depleted_share * F.col("total")).alias("depleted")), "result")


def judge(docs: DataFrame, spark: SparkSession, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", **limits) -> DataFrame:
    """Per row: id, the five base counts, base_failed, n_removed_lines, depleted, kept. Rows of equal id are judged each by its text."""
    found = shared_lines(docs, spark, text_col=text_col, host_col=host_col, **limits).select("k1", "k2", "n", "depleted")
    base = docs.select(F.col(id_col).alias("id"), *_keys(F.col(host_col), F.col(text_col)), base_counts(F.col(text_col)).alias("c"))
    failed = base_failed(F.col("c"))
    depleted = F.coalesce("depleted", F.lit(False))
    return base.join(found, ["k1", "k2"], "left").select(
        F.col("id").alias(id_col), "c.*", failed.alias("base_failed"), F.coalesce("n", F.lit(0)).cast("long").alias("n_removed_lines"), depleted.alias("depleted"), (~failed & ~depleted).alias("kept")
    )


def clean(docs: DataFrame, spark: SparkSession, *, text_col: str = "text", host_col: str = "source", chars_col: str = "n_chars", **limits) -> DataFrame:
    """The kept rows with all their columns; lines above the limits are cut from their texts, and chars_col follows."""
    found = shared_lines(docs, spark, text_col=text_col, host_col=host_col, **limits)
    found = found.select(F.col("k1").alias("__es_k1"), F.col("k2").alias("__es_k2"), F.when(~F.col("depleted"), F.col("lines")).alias("__es_lines"), F.col("depleted").alias("__es_depleted"))
    base = docs.where(~base_failed(base_counts(F.col(text_col))))
    k1, k2 = _keys(F.col(host_col), F.col(text_col))
    both = base.join(found, (k1 == F.col("__es_k1")) & (k2 == F.col("__es_k2")), "left").where(~F.coalesce("__es_depleted", F.lit(False)))
    rest = F.array_join(F.filter(F.split(F.col(text_col), "\n", -1), lambda x: ~F.array_contains("__es_lines", F.xxhash64(normal_line(x)))), "\n")
    text = F.when(F.size("__es_lines") > 0, rest).otherwise(F.col(text_col))
    out = both.withColumn("__es_text", text)
    new = {text_col: F.col("__es_text")} | ({chars_col: F.when(F.size("__es_lines") > 0, F.length("__es_text").cast("long")).otherwise(F.col(chars_col))} if chars_col in docs.columns else {})
    return out.select(*(new.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns))
