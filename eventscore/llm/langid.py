"""Language identification by rank-order profiles of character n-grams and the out-of-place distance."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch


@cache
def letters() -> np.ndarray:
    """By code point: whether it is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def ngrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The different 1- to 3-grams of a text's lower-cased words, with their counts. Words stand between blanks; no
    gram reaches over a blank. A gram is one number, 21 bits a character."""
    c = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), "<u4")
    c = np.where(letters()[c], c, 32).astype("i8")
    c = np.concatenate([[32], c, [32]])
    blank = c == 32
    c = c[~(blank & np.concatenate([[False], blank[:-1]]))]
    if len(c) < 3:
        return np.zeros(0, "i8"), np.zeros(0, "i8")
    blank = c == 32
    two = (c[:-1] << 21) | c[1:]
    three = ((c[:-2] << 42) | (c[1:-1] << 21) | c[2:])[~blank[1:-1]]
    return np.unique(np.concatenate([c[~blank], two, three]), return_counts=True)


def ranked(grams: np.ndarray, counts: np.ndarray, most: int) -> np.ndarray:
    """The most frequent grams, ties by gram."""
    return grams[np.lexsort((grams, -counts))[:most]]


def distances(doc: np.ndarray, profiles: list[tuple[np.ndarray, np.ndarray]], most: int) -> list[int]:
    """The out-of-place distance of a document's ranking to each profile (sorted grams, their ranks)."""
    rank, out = np.arange(len(doc)), []
    for keys, ranks in profiles:
        at = np.minimum(np.searchsorted(keys, doc), len(keys) - 1)
        out.append(int(np.where(keys[at] == doc, np.abs(rank - ranks[at]), most).sum()))
    return out


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def learn(docs: DataFrame, spark: SparkSession, *, id_col: str, text_col: str, lang_col: str, most: int = 300, sample: int = 20_000) -> dict[str, np.ndarray]:
    """Per language the ranking of its most frequent n-grams.

    Of a language with more than `sample` labelled rows about that many are read, chosen by a hash of the id; of others
    all. What reaches the driver is `most` numbers a language.
    """
    rows = docs.where(F.col(lang_col).isNotNull() & ~held_out(F.col(id_col))).select(F.col(lang_col).cast("string").alias("lang"), F.pmod(F.xxhash64(F.col(id_col)), F.lit(1 << 30)).alias("draw"), F.col(text_col).cast("string").alias("text"))
    scratch = Scratch(spark, "langid")
    sizes = scratch.table(rows.groupBy("lang").agg(F.count("*").alias("n")), "sizes").withColumnRenamed("lang", "_lang")
    some = rows.join(sizes, rows["lang"] == sizes["_lang"]).where(F.col("draw") * F.col("n") < F.lit(float(sample)) * (1 << 30)).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            by: dict[str, list] = {}
            for lang, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                by.setdefault(lang, []).append(ngrams(text.as_py()))
            for lang, found in by.items():
                grams, at = np.unique(np.concatenate([g for g, _ in found]), return_inverse=True)
                sums = np.bincount(at, np.concatenate([n for _, n in found]), len(grams)).astype("i8")
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams), pa.array(sums)], ["lang", "gram", "n"])

    counts = some.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    top = counts.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("rank") <= most)
    out: dict[str, list[int]] = {}
    for r in top.orderBy("lang", "rank").select("lang", "gram").collect():
        out.setdefault(r[0], []).append(r[1])
    return {k: np.array(v, "i8") for k, v in out.items()}


def predict(docs: DataFrame, profiles: dict[str, np.ndarray], *, id_col: str, text_col: str, most: int = 300) -> DataFrame:
    """id, held_out, lang_pred, score. The language at the smallest distance, ties by name; score is 1 less the distance
    as a share of the greatest possible. Null text or one without letters: `und`, score 0; so too without any profile."""
    langs = sorted(profiles)
    order = [np.argsort(profiles[k]) for k in langs]
    tables = [(profiles[k][o], o) for k, o in zip(langs, order, strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pred, score = [], []
            for text in b.column(2):
                doc = ranked(*ngrams(text.as_py()), most)
                if not len(doc) or not langs:
                    pred.append("und")
                    score.append(0.0)
                    continue
                d = distances(doc, tables, most)
                k = int(np.argmin(d))
                pred.append(langs[k])
                score.append(1 - d[k] / (most * len(doc)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(pred, pa.string()), pa.array(score, "f8")], [id_col, "held_out", "lang_pred", "score"])

    src = docs.select(F.col(id_col).cast("long").alias(id_col), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).cast("string").alias("_text"))
    return src.mapInArrow(run, f"`{id_col}` long, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame, spark: SparkSession, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most: int = 300, sample: int = 20_000) -> DataFrame:
    """Learns profiles from the rows that aren't held out, predicts every row from its whole text alone.

    A row is held out if crc32 of its id as text leaves 1 modulo 3; a row without id isn't. Repeated rows count as often
    as they stand there; only text, lang and id are read.
    """
    return predict(docs, learn(docs, spark, id_col=id_col, text_col=text_col, lang_col=lang_col, most=most, sample=sample), id_col=id_col, text_col=text_col, most=most)
