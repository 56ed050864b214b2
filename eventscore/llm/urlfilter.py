"""URL filters: domain and path rules; for other URLs, host words by unigram Viterbi and multinomial naive Bayes."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z in lower case; empty without."""
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null without one. Rules: (`host/path...`, allow or block)."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        h, _, p = rule.partition("/")
        h = h.lower()
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(f"/{p}")
        name, verdict = F.when(fits, rule).otherwise(name), F.when(fits, says).otherwise(verdict)
    return name, verdict


def viterbi(token: str, logp: dict[str, float], unknown: float, longest: int = 24) -> list[str]:
    """The likeliest split into words of at most longest letters; a piece that isn't a word costs `unknown` and more for
    each letter. Ties: the longer last word."""
    best: list[tuple[float, int]] = [(0.0, 0)]
    for end in range(1, len(token) + 1):
        score = lambda at: best[at][0] + logp.get(token[at:end], unknown - 2.4 * (end - at))  # noqa: E731, B023
        at = max(range(max(0, end - longest), end), key=lambda a: (score(a), -a))
        best.append((score(at), at))
    out, end = [], len(token)
    while end:
        at = best[end][1]
        out.append(token[at:end])
        end = at
    return out[::-1]


def word_counts(texts: DataFrame, text_col: str, markup: bool, longest: int = 24) -> DataFrame:
    """(word, n) of the letter words of 2 to longest letters in all whole texts."""
    t = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    t = F.regexp_replace(t, "<[^>]*>", " ") if markup else t
    words = F.explode(F.split(F.lower(t), "[^\\p{L}]+"))
    return texts.select(words.alias("word")).where(F.length("word").between(2, longest)).groupBy("word").agg(F.count("*").alias("n"))


def split_tokens(tokens: DataFrame, counts: DataFrame, scratch: Scratch, longest: int = 24) -> DataFrame:
    """(token, words) for different tokens: each is split with the counts of the words that it contains.

    The substrings of the tokens, a row each under the token's number, meet the corpus' counts in a join, so the unigram
    model is the whole corpus' however large, and each token's split sees only the words in it.
    """
    tokens = scratch.table(tokens.select(F.monotonically_increasing_id().alias("no"), "token"), "numbered")
    counts = scratch.table(counts, "counts")
    log_all = math.log(counts.agg(F.sum("n")).first()[0] or 1)
    at = tokens.select("no", "token", F.explode(F.sequence(F.lit(1), F.length("token"))).alias("at")).where(F.col("at") < F.length("token"))
    lengths = F.sequence(F.lit(2), F.least(F.lit(longest), F.length("token") - F.col("at") + 1))
    parts = at.select("no", F.explode(F.transform(lengths, lambda n: F.substring(F.col("token"), F.col("at"), n))).alias("word")).distinct()
    known = parts.join(counts, "word").groupBy("no").agg(F.collect_list(F.struct("word", "n")).alias("known"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            split = []
            for token, own in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                split.append(viterbi(token, {x["word"]: math.log(x["n"]) - log_all for x in own or ()}, -log_all, longest))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(split, pa.list_(pa.string()))], ["token", "words"])

    return scratch.table(tokens.join(known, "no", "left").select("token", "known").mapInArrow(run, "token string, words array<string>"), "split")


def bayes_weights(counts: DataFrame, smoothing: float) -> DataFrame:
    """(word, weight) of a multinomial naive Bayes over (word, bad, good): the log odds of bad against good in millionths,
    so that sums don't depend on their order. Each word has `smoothing` pseudo-counts, dealt to the classes by their sizes,
    so a word that was never seen says nothing. No weights if a class is empty."""
    n = counts.agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).first()
    bad, good = n["bad"] or 0, n["good"] or 0
    if not bad or not good:
        return counts.select("word", F.lit(0).cast("long").alias("weight")).limit(0)
    each = smoothing / (bad + good)
    return counts.select("word", F.round(1e6 * F.ln((F.col("bad") / bad + each) / (F.col("good") / good + each))).cast("long").alias("weight"))


def judge_urls(pages: DataFrame, spark: SparkSession, rules: list[tuple[str, str]], *, labelled: DataFrame | None = None, texts: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", text_col: str = "html", markup: bool = True, prior: float = 0.1, smoothing: float = 1.0, longest: int = 24) -> DataFrame:
    """Per row: id, host, path, rule (null if none fits), verdict, score (log odds of blocking, null with a rule).

    Letter runs of two letters or more in host and path are tokens. Each is split into words by the likeliest unigram
    split; unigrams are counted over all rows of texts (pages itself by default). A multinomial naive Bayes adds up the
    words' log odds, and a sum over 0 blocks. It learns from all rows that the rules decide, with the rules' verdicts as
    labels, and from the rows of labelled (url, blocked) if given; the words that the rules themselves are written with
    are left out of it, or it would only learn the rules again. prior is the share of urls to block before any word is
    seen (the rows that rules decide are no sample of the others). longest is the most letters of a word: longer words
    aren't in the unigram model, and a token is split into pieces of at most so many.

    Null url or one without ://: host and path empty, no rule, allowed. Every row is judged, repeated rows and null ids
    too; a url of any length is split whole. The rules are a parameter and stand in the plan: at most 1,000.
    """
    if len(rules) > 1000:
        raise ValueError("more than 1,000 rules")
    own_words = sorted({w for rule, _ in rules for w in regex.findall(r"\p{L}+", rule.lower())})
    scratch = Scratch(spark, "urls")
    url = F.col("url")
    src = pages.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"))
    src = src.select("row", "id", host_of(url).alias("host"), path_of(url).alias("path"))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    src = scratch.table(src.withColumn("rule", name).withColumn("verdict", verdict), "rows")

    def runs(df: DataFrame, *keep: str) -> DataFrame:
        every = F.filter(F.split(F.concat_ws("/", "host", F.lower("path")), "[^\\p{L}]+"), lambda x: (F.length(x) > 1) & ~x.isin(own_words))
        return df.select(*keep, F.explode(every).alias("token"))

    told = runs(src.where("verdict is not null"), "verdict").groupBy("token").agg(F.count_if(F.col("verdict") == "block").alias("bad"), F.count_if(F.col("verdict") != "block").alias("good"))
    if labelled is not None:
        more = labelled.select(F.col("url").cast("string").alias("url"), F.col("blocked").cast("boolean").alias("blocked")).where("blocked is not null")
        more = runs(more.select(host_of(url).alias("host"), path_of(url).alias("path"), "blocked"), "blocked")
        told = told.union(more.groupBy("token").agg(F.count_if("blocked").alias("bad"), F.count_if(~F.col("blocked")).alias("good"))).groupBy("token").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    told = scratch.table(told, "told")
    each = runs(src.where("verdict is null"), "row")
    tokens = told.select("token").union(each.select("token").distinct()).distinct()
    split = split_tokens(tokens, word_counts(texts if texts is not None else pages, text_col, markup, longest), scratch, longest)
    counts = told.join(split, "token").select(F.explode("words").alias("word"), "bad", "good").where(~F.col("word").isin(own_words)).groupBy("word").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    weights = scratch.table(bayes_weights(scratch.table(counts, "learned"), smoothing), "weights")
    scored = split.select("token", F.explode("words").alias("word")).join(weights, "word").groupBy("token").agg(F.sum("weight").alias("score")).where("score <> 0")
    scored = scratch.table(scored, "scored")
    sums = scratch.table(each.join(scored, "token").groupBy("row").agg(F.sum("score").alias("sum")).withColumnRenamed("row", "_row"), "sums")
    total = F.coalesce("sum", F.lit(0)) + round(1e6 * math.log(prior / (1 - prior)))
    own = F.when(total > 0, "block").otherwise("allow")
    return src.join(sums, F.col("row") == F.col("_row"), "left").select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("verdict", own).alias("verdict"), F.when(F.col("verdict").isNull(), total / 1e6).alias("score"))
