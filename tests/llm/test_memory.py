"""What operators leave in Python workers, which outlive their stages, and how much goes to a worker at once."""

from __future__ import annotations

import re
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from eventscore.llm import common, copies, simhash, tokenbin


def seen_by_copies(spark, docs, monkeypatch, tmp_path):
    """The bytes of every batch of texts that classes fingerprints from a worker, as it notes them in files."""
    lean = common.lean

    def noting(run, keeps=""):
        if run.__name__ != "sketch":
            return lean(run, keeps)

        def note(batches):
            for b in batches:
                (tmp_path / f"{b.num_rows}-{b.nbytes}-{b.column(0)[0].as_py()}").touch()
                yield b

        return lean(lambda batches: run(note(batches)), keeps)

    monkeypatch.setattr(copies, "lean", noting)
    got = copies.classes(docs, spark).select("id", "group").collect()
    return got, [int(p.name.split("-")[1]) for p in tmp_path.iterdir()]


def test_copies_reads_texts_in_small_batches(spark, monkeypatch, tmp_path):
    # 24 MB of texts in one partition: one batch as Spark deals them, now some of about 4 MB each
    text = F.concat_ws(" ", *(F.concat(F.lit(f"w{k}x"), F.col("id") % 500) for k in range(800)))
    docs = spark.range(0, 3000, 1, 1).select(F.col("id").alias("doc_id"), text.alias("text"))
    was = spark.conf.get(common.BATCH)
    got, sizes = seen_by_copies(spark, docs, monkeypatch, tmp_path)
    assert sum(sizes) > 20e6 and max(sizes) < 6e6
    # every row in its group all the same, and the session as it was
    groups = {}
    for r in got:
        groups.setdefault(r["group"], set()).add(r["id"])
    assert sorted(map(len, groups.values())) == [6] * 500 and all(len({i % 500 for i in g}) == 1 for g in groups.values())
    assert spark.conf.get(common.BATCH) == was


def test_small_batches_put_back_the_setting(spark):
    was = spark.conf.get(common.BATCH)
    one, two = common.small_batches(spark), common.small_batches(spark)
    one.__enter__()
    two.__enter__()
    one.__exit__(None, None, None)
    assert spark.conf.get(common.BATCH) == str(4 << 20)
    two.__exit__(None, None, None)
    assert spark.conf.get(common.BATCH) == was
    spark.conf.set(common.BATCH, "1234567")
    try:
        with pytest.raises(KeyError), common.small_batches(spark):
            raise KeyError
        assert spark.conf.get(common.BATCH) == "1234567"
    finally:
        spark.conf.unset(common.BATCH)


def test_lean_tasks_let_go_of_what_others_keep(monkeypatch):
    monkeypatch.setitem(tokenbin.Encoder._kept, ("path", 1), object())
    batch = pa.RecordBatch.from_pydict({"x": [1]})
    assert list(common.lean(iter, "encoders")([batch])) == [batch] and ("path", 1) in tokenbin.Encoder._kept
    assert list(common.lean(iter)([batch])) == [batch] and not tokenbin.Encoder._kept


def test_lean_tasks_give_memory_back():
    """Small blocks in the heap, of which the last stays: without trimming all of it stays with the process."""

    def held() -> int:
        return sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text()))) // 1024

    last = []

    def run(batches):
        some = [np.zeros(60_000, "u1") + 1 for _ in range(3000)]
        last.append(some.pop())
        del some
        last.append(held())
        yield from batches

    list(common.lean(run)([]))
    assert held() < last[1] - 100


def test_fingerprints_in_pieces_are_the_same():
    rng = np.random.default_rng(1)
    texts = [" ".join(map(str, rng.integers(0, 50, n))).encode() for n in (0, 3, 5, 200, 40_000, 70_000, 7)] + [None]
    assert (simhash.fingerprints(texts, 5, 42, copies.PIECE) == simhash.fingerprints(texts, 5, 42)).all()
