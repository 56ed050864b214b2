"""What the operators share: the shared folder, staged tables, words, connected components."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import wraps

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than space and U+0009..U+000D.
SPACE = "[\\x20\\x09-\\x0D]+"
SPACES = " \t\n\x0b\x0c\r"


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset a local master gets an own one
    (tests); on a cluster executors could not see it, so that raises."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = root.get() if root.isDefined() else None
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = f"file://{tempfile.mkdtemp(prefix='eventscore-')}"
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


#: The lists of gathering() that are open in this context.
_open: ContextVar[tuple[list[Scratch], ...]] = ContextVar("open", default=())


@contextmanager
def gathering() -> Iterator[list[Scratch]]:
    """The scratch folders that are made inside, in this thread or task alone."""
    made: list[Scratch] = []
    token = _open.set((*_open.get(), made))
    try:
        yield made
    finally:
        _open.reset(token)


class Scratch:
    """A folder for one run of an operator, below the shared one; it goes when the session ends, or by release()."""

    def __init__(self, spark: SparkSession, name: str):
        for made in _open.get():
            made.append(self)
        self.spark = spark
        self.path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        jvm = spark.sparkContext._jvm
        self._at = jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = self._at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._at)
        self._fs.deleteOnExit(self._at)

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Writes df and reads it again: cuts the lineage, survives lost executors, and gives Spark the true size."""
        df.write.parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def release(self) -> None:
        """Deletes the folder; what was lazily derived from its tables can't be read afterwards."""
        self._fs.delete(self._at, True)

    def drop(self, *names: str) -> None:
        for name in names:
            self._fs.delete(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}"), True)


#: The setting that bounds the bytes of a batch that goes to a Python worker; by session what it was before, once for each
#: thread that holds it lower.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
_lowered: dict[str, list[str | None]] = {}
_lowering = threading.Lock()


@contextmanager
def small_batches(spark: SparkSession, size: int = 4 << 20) -> Iterator[None]:
    """What is written inside goes to Python workers in batches of about `size` bytes instead of Spark's 64 MB, which an
    executor holds twice and more for each task, in the JVM's buffers and the worker's. Threads may overlap: the last one
    to leave puts back what the first one found."""
    key = spark._jsparkSession.sessionUUID()
    with _lowering:
        held = _lowered.setdefault(key, [])
        held.append(held[0] if held else spark.conf.get(BATCH, None))
        spark.conf.set(BATCH, str(size))
    try:
        yield
    finally:
        with _lowering:
            was = held.pop()
            if not held:
                del _lowered[key]
                spark.conf.set(BATCH, was) if was else spark.conf.unset(BATCH)


def in_small_batches(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """An operator f(docs, spark, ...) whose scratch tables are written in small batches; what it returns to be written
    later has Spark's."""

    @wraps(f)
    def run(docs: DataFrame, spark: SparkSession, *args, **how) -> DataFrame:
        with small_batches(spark):
            return f(docs, spark, *args, **how)

    return run


#: What a Python worker keeps from task to task, by kind. Workers outlive stages, so a lean task of another kind lets it go.
KEPT: dict[str, dict] = {}


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], keeps: str = "") -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function of mapInArrow that leaves its worker small: before it, what the worker keeps goes, but for the kind
    `keeps`; behind it, memory that is free goes back to the system."""

    def run_lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go(keeps)
        try:
            yield from run(batches)
        finally:
            give_back()

    return run_lean


def let_go(keeps: str = "") -> None:
    for kind, held in KEPT.items():
        if kind != keeps:
            held.clear()


def give_back() -> None:
    """Gives this process' free memory back to the system; allocators else keep it for the next task."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc's; other libraries have none
        trim(0)


def open_store(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a shared folder (file, hdfs, s3, gs ...), for use on executors, and the path in it."""
    return pafs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}" if uri.startswith("/") else uri.replace(":", "://", 1))


def let(value: Column, body) -> Column:
    """body(value), with value computed once: a lambda's variable holds what it is bound to."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The words of a text; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def n_words(text: Column) -> Column:
    """How many words a text has, without making an array of them: the starts of words."""
    t = F.coalesce(text, F.lit(""))
    return F.regexp_count(t, F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")


def connected(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Connected components of edges (a, b) of longs: (v, root), root the smallest vertex reachable.

    Alternating large-star and small-star steps. Every step is joins and partial aggregates by vertex; a hub of any
    size is only one side of a join that Spark can split. Each round is written to the shared folder.
    Vertices without edges don't appear; loops and repeated edges don't matter. The rounds end when nothing changes,
    after about the logarithm of the longest path, squared at worst.
    """
    now = scratch.table(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "cc0")
    mark = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    was = mark(now)
    i = 0
    while was[0]:
        i += 1
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = scratch.table(large, f"cc{i}l")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        nxt = scratch.table(small.union(least.select("a", F.col("m").alias("b"))).distinct(), f"cc{i}")
        scratch.drop(f"cc{i - 1}", f"cc{i}l")
        is_ = mark(nxt)
        now = nxt
        if is_ == was:
            break
        was = is_
    return now.select(F.col("a").alias("v"), F.col("b").alias("root"))
