"""A corpus from raw documents to token files: quality, near-duplicates, benchmark leaks, mixture, tokens."""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from eventscore.llm import copies
from eventscore.llm.common import Scratch, gathering
from eventscore.llm.decontaminate import CAPITALS, NAMES, without_leaks
from eventscore.llm.mixing import take
from eventscore.llm.quality import clean
from eventscore.llm.queries import tokenizer_path
from eventscore.llm.simhash import keep_one
from eventscore.llm.tokenbin import token_table


#: The scratch folders of the stage that ran last in this thread, by application. Threads run pipelines beside each other.
_held = threading.local()


def release() -> None:
    """Deletes the scratch folders of this thread's last stage."""
    for scratch in _held.__dict__.pop("scratch", []):
        scratch.release()


def stage(f: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage of a thread begins when its predecessor's result is written, so the predecessor's scratch tables go first."""

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release()
        with gathering() as made:
            out = f(spark, docs, sf_dir)
        _held.scratch = made
        return out

    run_stage.__doc__ = f.__doc__
    return run_stage


@stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, without lines of more than 10 different documents of a host, whatever the host's size."""
    return clean(docs, spark, min_docs=10)


@stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near copies: fingerprints of five words within 7 bits, checked
    by a similarity of at least 0.8, and an exact way for similar texts whose fingerprints are further apart."""
    return keep_one(docs, spark, find=copies.classes, width=5, radius=7, similarity=0.8)


@stage
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item, judged at every alignment and with names at starts too; numbers needn't agree."""
    return without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), spark, strict=False, names=(NAMES, CAPITALS))


@stage
def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    return take(docs, spark)


@stage
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token files' documents, read back: doc_id, start, n_tokens, ids_crc32. The executors' heaps have grown in the
    stages before, so the encoder remembers less than alone, and leaves nothing in the workers that the next run uses."""
    return token_table(docs, spark, tokenizer_path(), memory=48 << 20, chars=1 << 20, spare=True)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontamination", decontamination), ("mixture", mixture), ("tokens", tokens)]

#: Hashes, dependent rounding and the tokenizer have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's rows are written to the shared folder and read again. A run has its own
    folders; what stages called before it in this thread left behind stays."""
    scratch, before = Scratch(spark, "pipeline"), _held.__dict__.pop("scratch", [])
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    last = ""
    try:
        for name, step in STAGES:
            docs = scratch.table(step(spark, docs, sf_dir), name)
            scratch.drop(*[last] * bool(last))
            last = name
    finally:
        release()
        _held.scratch = before
    return docs
