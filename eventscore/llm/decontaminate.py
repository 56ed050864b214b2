"""Benchmark decontamination by templates: numbers, names and units become typed places. DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, let

#: Marks of the typed places; U+0001 is in no normal word.
NUMBER, UNIT, NAME = "\x01d", "\x01u", "\x01n"
NUMBERS = "\\p{N}+(?:[.,:/]\\p{N}+)*"
#: A capitalised word that follows a word, a number or a comma on the same line; at a sentence's start it says nothing.
NAMES = "\\p{Lu}(?<=[\\p{L}\\p{N},;] .)\\p{Ll}+"
#: Any capitalised word, those at the start of a text, a sentence, a line or a quotation too.
CAPITALS = "(?<![\\p{L}\\p{N}])\\p{Lu}\\p{Ll}+"
UNITS = "mm|cm|m|km|in|ft|mi|miles|mg|g|kg|lb|oz|ml|l|s|sec|seconds|min|minutes|h|hours|days|weeks|months|years|mph|kmh|percent|usd|eur|dollars|euros|cents|degrees|kb|mb|gb|hz|khz|w|kw|v"


def canonical(text: Column, names: str = NAMES) -> Column:
    t = F.regexp_replace(F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), "\x01", " "), names, f" {NAME} ")
    t = F.regexp_replace(F.lower(F.regexp_replace(t, NUMBERS, f" {NUMBER} ")), f"{NUMBER} ?\\s?(?:{UNITS})(?![\\p{{L}}\\p{{N}}])", f"{NUMBER} {UNIT} ")
    return t


def template(text: Column, names: str = NAMES) -> Column:
    """The template's words: typed places, and other words in lower case without punctuation."""
    return F.filter(F.split(canonical(text, names), "[^\\p{L}\\p{N}\x01]+"), lambda w: w != "")


def window_hashes(t: Column, width: int) -> Column:
    """A hash for each window of width words of a template; none if it is shorter."""
    many = F.transform(F.sequence(F.lit(0), F.size(t) - width), lambda i: F.xxhash64(*(F.get(t, i + k) for k in range(width))))
    return F.when(F.size(t) < width, F.array().cast("array<bigint>")).otherwise(many)


def slots(text: Column, t: Column, names: str = NAMES) -> Column:
    """ARRAY of (pos, kind, value): the typed places of a template with what stood there. Units count with their numbers."""
    clean = F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), "\x01", " ")
    named = F.regexp_extract_all(clean, F.lit(f"({names})"), F.lit(1))
    numbers = F.regexp_extract_all(clean, F.lit(f"({NUMBERS})"), F.lit(1))
    places = lambda kind: F.filter(F.transform(t, lambda w, i: F.when(w == kind, i)), lambda i: i.isNotNull())
    typed = lambda kind, values: F.transform(F.arrays_zip(places(kind).alias("pos"), values.alias("value")), lambda z: F.struct(z["pos"].alias("pos"), F.lit(kind).alias("kind"), z["value"].alias("value")))
    return F.concat(typed(NAME, named), typed(NUMBER, numbers))


def whole_hash(t: Column, width: int) -> Column:
    """The hash of all the words of a template of 2 to width - 1 words, as window_hashes makes it; else null."""
    out = F.lit(None).cast("long")
    for m in range(2, width):
        out = F.when(F.size(t) == m, F.xxhash64(*(F.get(t, k) for k in range(m)))).otherwise(out)
    return out


def leaks(docs: DataFrame, items: DataFrame, spark: SparkSession, *, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = 5, similarity: float = 0.8, broadcast_rows: int = 4_000_000, names: str = NAMES, strict: bool = True) -> DataFrame:
    """(key, id, item_id, similarity, n_windows, n_slots, n_changed); key is a hash of a document's id and text. See contaminated."""
    scratch = Scratch(spark, "decontaminate")
    asked = items.select(F.col(item_id).alias("item_id"), F.col(item_text).cast("string").alias("item_text")).distinct()
    asked = asked.withColumn("t", template(F.col("item_text"), names)).withColumn("ikey", F.xxhash64("item_id", "item_text"))
    asked = scratch.table(asked, "items")
    words_in = lambda a: F.size(F.filter(a, lambda w: ~w.startswith("\x01")))
    grams = asked.select("ikey", "t", F.posexplode(window_hashes(F.col("t"), width)).alias("ipos", "h")).where(words_in(F.slice("t", F.col("ipos") + 1, width)) >= 2).select("ikey", "ipos", "h")
    short = asked.select("ikey", F.lit(0).alias("ipos"), whole_hash(F.col("t"), width).alias("h"), F.size("t").alias("m")).where(F.col("h").isNotNull() & (words_in(F.col("t")) >= 2))
    lengths = sorted(r["m"] for r in short.select("m").distinct().collect())
    grams = scratch.table(grams.union(short.drop("m")), "grams")
    wanted = scratch.table(grams.select("ikey", "h").distinct(), "wanted")
    of_item = scratch.table(wanted.groupBy("ikey").agg(F.count("*").alias("n_windows")), "of_item")
    small = wanted.count() <= broadcast_rows
    fit = F.broadcast if small else (lambda df: df)
    every = lambda t: F.concat(window_hashes(t, width), *(window_hashes(t, m) for m in lengths))

    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    key = F.xxhash64("id", "text").alias("key")
    have = src.select(key, let(template(F.col("text"), names), lambda t: F.array_distinct(every(t))).alias("hs")).select("key", F.explode("hs").alias("h"))
    met = have.join(fit(wanted), "h").groupBy("key", "ikey", "h").agg(F.lit(1).alias("one")) if not small else have.join(fit(wanted), "h").distinct()
    near = met.groupBy("key", "ikey").agg(F.count("*").alias("n")).join(of_item, "ikey").where(F.col("n") >= similarity * F.col("n_windows"))
    near = scratch.table(near.select("key", "ikey", "n_windows", (F.col("n") / F.col("n_windows")).alias("similarity")), "near")
    keys = scratch.table(near.select("key").distinct(), "keys")
    leaky = src.withColumn("key", key).join(keys, "key", "left_semi").dropDuplicates(["key"])
    leaky = scratch.table(leaky.withColumn("t", template(F.col("text"), names)).select("id", "key", "t", slots(F.col("text"), F.col("t"), names).alias("s")), "leaky")

    at = leaky.select("key", F.posexplode(window_hashes(F.col("t"), width)).alias("pos", "h"))
    for m in lengths:
        at = at.union(leaky.select("key", F.posexplode(window_hashes(F.col("t"), m)).alias("pos", "h")))
    lined = near.select("key", "ikey").join(at, "key").join(grams, ["ikey", "h"]).select("key", "ikey", "ipos", "h", (F.col("pos") - F.col("ipos")).alias("shift"))
    best = lined.groupBy("key", "ikey", "shift").agg(F.count("*").alias("n")).groupBy("key", "ikey").agg(F.max(F.struct("n", -F.col("shift"))).alias("b")).select("key", "ikey", (-F.col("b.col2")).alias("shift"))
    if not strict:
        whole = lined.groupBy("key", "ikey", "shift").agg(F.count_distinct("h").alias("n")).join(near, ["key", "ikey"]).where(F.col("n") >= similarity * F.col("n_windows"))
        best = best.union(whole.select("key", "ikey", "shift")).distinct()
    told_items = asked.select("ikey", "item_id", F.size("t").alias("size"), slots(F.col("item_text"), F.col("t"), names).alias("is"))
    sides = best.join(leaky.select("key", "id", "s"), "key").join(told_items, "ikey")
    # the places of the stretch that the item covers, so that what is paired is bounded by the item
    own = F.filter("s", lambda b: (b["pos"] >= F.col("shift")) & (b["pos"] < F.col("shift") + F.col("size")))
    pairs = let(own, lambda here: F.filter(
        F.flatten(F.transform("is", lambda a: F.transform(F.filter(here, lambda b: (b["pos"] == a["pos"] + F.col("shift")) & (b["kind"] == a["kind"])), lambda b: F.struct(a["kind"].alias("kind"), a["value"].alias("a"), b["value"].alias("b"))))),
        lambda p: p["a"].isNotNull() & p["b"].isNotNull(),
    ))
    told = sides.select("key", "ikey", "shift", "id", "item_id", "size", pairs.alias("p"))
    kinds = lambda *cols, p=F.col("p"): F.size(F.array_distinct(F.transform(p, lambda x: F.struct(x["kind"], *(x[n] for n in cols)))))
    changed = F.size(F.filter("p", lambda x: x["a"] != x["b"]))
    told = told.where((F.col("size") >= width) | (changed == 0))
    if strict:
        agreed = told.where((kinds("a") == kinds("a", "b")) & (kinds("b") == kinds("a", "b")))
    else:
        of_names = F.filter("p", lambda x: x["kind"] == NAME)
        agreed = told.where((kinds("a", p=of_names) == kinds("a", "b", p=of_names)) | (2 * changed <= F.size("p")))
        first = F.min(F.struct(changed.alias("changed"), "shift", "id", "item_id", "p")).alias("x")
        agreed = agreed.groupBy("key", "ikey").agg(first).select("key", "ikey", "x.id", "x.item_id", "x.p")
    return agreed.join(near, ["key", "ikey"]).select("key", "id", "item_id", "similarity", "n_windows", F.size("p").cast("long").alias("n_slots"), changed.cast("long").alias("n_changed"))


def contaminated(docs: DataFrame, items: DataFrame, spark: SparkSession, *, id_col: str = "doc_id", **how) -> DataFrame:
    """The leaks: (id, item_id, similarity, n_windows, n_slots, n_changed), one row a document and benchmark item.

    Documents and items become templates; a document leaks an item if it has at least `similarity` of the item's
    different windows of `width` template words, found by a hash join, and if the typed places agree along the best
    alignment: equal values of the item stand for equal values of the document, and different ones for different ones.
    So a question with other numbers and names is caught, a text that only shares its shape isn't. n_changed counts
    places with another value. Without strict, every alignment that has the share of the windows is judged beside the
    best one, and it is enough that the item's names agree (one value in the document for each) or that at least half of
    the places are unchanged: new numbers may coincide. names says what is a name. Windows with fewer than two plain
    words identify nothing and aren't searched. An item of fewer than width template words, two of them plain, is leaked
    by a document that has all its words in a row with nothing changed: so short a template alone says too little.

    Null texts, and texts shorter than an item's windows, leak nothing. Rows of docs with equal id and
    text count once, as do items with equal id and text; rows without id are kept apart by their texts, with a null id.
    The items' windows are broadcast only up to broadcast_rows (16 bytes each); beyond that the join is shuffled.
    """
    return leaks(docs, items, spark, id_col=id_col, **how).drop("key").withColumnRenamed("id", id_col)


def without_leaks(docs: DataFrame, items: DataFrame, spark: SparkSession, *, id_col: str = "doc_id", text_col: str = "text", names: tuple[str, ...] = (NAMES,), **how) -> DataFrame:
    """The rows of docs that leak no item, with all their columns. Every row is judged by its own text, whatever its id.

    With several kinds of names a document leaks if it does by the templates of one of them.
    """
    found = [leaks(docs, items, spark, id_col=id_col, text_col=text_col, names=n, **how).select(F.col("id").alias("__es_leak"), F.col("key").alias("__es_of")) for n in names]
    found = Scratch(spark, "leaks").table(reduce(DataFrame.union, found).distinct(), "ids")
    own = F.xxhash64(F.col(id_col), F.col(text_col).cast("string"))
    return docs.join(found, F.col(id_col).eqNullSafe(F.col("__es_leak")) & (own == F.col("__es_of")), "left_anti")
