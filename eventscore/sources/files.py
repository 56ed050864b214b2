"""Sinks and sources beside plain tables: documents, JSON without non-finite numbers, histories, text tables, number lines."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where that is unset a local master gets an own folder (tests); on a cluster executors could not
    see it, so that raises."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = f"file://{tempfile.mkdtemp(prefix='eventscore-')}"
    return root.rstrip("/")


def _path(spark: SparkSession, at: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one; it goes with the session."""
    path, fs = _path(spark, f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}")
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return path.toString()


def staged(df: DataFrame, name: str = "staged") -> DataFrame:
    """df written once to the shared folder and read again: what follows several times from it is computed once."""
    at = shared_folder(df.sparkSession, name)
    df.write.mode("overwrite").parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def replace(df: DataFrame, path: str, **options) -> None:
    """Writes JSON lines to a staging path and then takes the place of path: the old files are renamed aside before, come
    back if the rename fails, and go at last. After a crash in between recover() brings them back, so none are lost."""
    spark = df.sparkSession
    recover(spark, path)
    df.write.mode("overwrite").options(**options).json(f"{path}.part")
    (at, fs), (part, _), (old, _) = (_path(spark, x) for x in (path, f"{path}.part", f"{path}.old"))
    had = fs.exists(at)
    if had and not fs.rename(at, old):
        raise OSError(f"could not move {path} aside")
    if not fs.rename(part, at):
        if had:
            fs.rename(old, at)
        raise OSError(f"could not rename to {path}")
    if had:
        fs.delete(old, True)


def recover(spark: SparkSession, path: str) -> None:
    """Ends a replace() that was cut off: with the new files where they stand, else with the old ones."""
    (at, fs), (old, _) = _path(spark, path), _path(spark, f"{path}.old")
    if fs.exists(old):
        if fs.exists(at):
            fs.delete(old, True)
        elif not fs.rename(old, at):
            raise OSError(f"could not bring {path} back")


def finite(c: Column) -> Column:
    """Null for NaN and infinities."""
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def to_json(c: Column) -> Column:
    """JSON in which nulls are written."""
    return F.to_json(c, {"ignoreNullFields": "false"})


def append_history(runs: DataFrame, path: str, order: list[str] | None = None) -> None:
    """Appends runs as JSON lines, once and only when all of them are computed, with `seq`, their place in the history: they
    follow what is there, among themselves by order (by all their columns if None). An append is a few lines, one a run."""
    spark = runs.sparkSession
    at, fs = _path(spark, path)
    last = (spark.read.schema("seq long").json(path).agg(F.max("seq")).first()[0] or 0) if fs.exists(at) else 0
    place = F.row_number().over(Window.orderBy(*(order or runs.columns)))
    runs.withColumn("seq", (F.lit(last) + place).cast("long")).write.mode("append").json(path)


def read_history(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Runs with `seq`, their place in the order of appends: files have no order of lines. Blank lines are skipped."""
    return spark.read.schema(f"{schema}, seq long").json(path)


def fixed_width(columns: dict[str, int], *, left: tuple[str, ...] = ()) -> Column:
    """A line of a text table: cells padded to their widths, numbers at the right; null is a dash."""
    cell = lambda c, w: (F.rpad if c in left else F.lpad)(F.coalesce(F.col(c).cast("string"), F.lit("-")), w, " ")
    return F.concat_ws("  ", *(cell(c, w) for c, w in columns.items()))


def stream_lines(head: Column, meta: list[Column], lines: Column, omitted: Column) -> Column:
    """A stream's text: its header, meta lines, lines and an empty one; an omitted stream is a comment that says why."""
    shown = F.concat(F.array(F.concat(F.lit(":"), head)), F.filter(F.array(*meta), lambda m: m.isNotNull()), lines, F.array(F.lit("")))
    why = F.concat(F.lit("# :"), head, F.lit(" omitted — "), omitted)
    return F.when(omitted.isNotNull(), why).otherwise(F.array_join(shown, "\n"))


def documents(streams: DataFrame, lines: DataFrame) -> DataFrame:
    """(doc_id, text) of streams (doc_id, stream_pos, head, meta, omitted) and lines (doc_id, stream_pos, pos, line).

    Lines are gathered by stream, then streams by document: a document is the unit that a reader takes whole.
    """
    of_stream = lines.groupBy("doc_id", "stream_pos").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]).alias("_lines"))
    text = stream_lines(F.col("head"), [F.col("meta")], F.coalesce("_lines", F.array().cast("array<string>")), F.col("omitted"))
    whole = streams.join(of_stream, ["doc_id", "stream_pos"], "left").select("doc_id", "stream_pos", text.alias("text"))
    return whole.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("stream_pos", "text"))), lambda x: x["text"]), "\n").alias("text"))


def number_lines(df: DataFrame, by: list[str], at: str, value: str, *, rate: float = 50.0, width: int = 50) -> DataFrame:
    """(by, pos, line): `f0 @t v v v`, `width` values a line at most, of a series at `rate` values a second. A line ends at a
    gap, so each value's time follows from its line's start."""
    w = Window.partitionBy(*by).orderBy(at)
    gap = F.coalesce(F.col(at) - F.lag(at).over(w) > 1.5 / rate, F.lit(True))
    runs = df.select(*by, F.col(at).alias("_at"), F.col(value).alias("_value"), gap.cast("long").alias("_new")).withColumn("_run", F.sum("_new").over(Window.partitionBy(*by).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)))
    placed = runs.withColumn("_line", F.floor((F.row_number().over(Window.partitionBy(*by, "_run").orderBy("_at")) - 1) / width))
    cells = F.transform(F.sort_array(F.collect_list(F.struct(F.col("_at").alias("at"), F.round("_value").cast("long").cast("string").alias("v")))), lambda x: x["v"])
    each = placed.groupBy(*by, "_run", "_line").agg(F.min("_at").alias("_t"), cells.alias("_v"))
    return each.select(*by, F.round(F.col("_t") * rate).cast("long").alias("pos"), F.concat(F.format_string("f0 @%.3f ", "_t"), F.array_join("_v", " ")).alias("line"))


def number_rows(rows: DataFrame, *, rate: float = 50.0) -> DataFrame:
    """(doc_id, stream, t, value) of the f0 statements of parsed documents; a value that is no number is null."""
    f0 = rows.where("kind = 'statement' and name = 'f0'").withColumn("_t", F.regexp_replace(F.col("args")[0], "^@", "").try_cast("double"))
    each = f0.select("doc_id", "stream", "_t", F.posexplode(F.slice("args", 2, F.greatest(F.lit(0), F.size("args") - 1))).alias("_i", "_v"))
    return each.select("doc_id", "stream", (F.col("_t") + F.col("_i") / rate).alias("t"), F.col("_v").try_cast("double").alias("value"))


def classify(path: Column) -> Column:
    """What a found file is: STRUCT of kind, name and strength; null for scratch, comparisons and hidden files."""
    name = F.regexp_extract(path, "([^/]+)$", 1)
    kind = F.when(path.rlike("/stems/"), "stem").when(name.rlike("\\.sc$"), "document").when(name.rlike("\\.(wav|mp3|flac)$"), "audio").when(name.rlike("\\.(json|jsonl)$"), "record").otherwise("other")
    strength = F.regexp_extract(name, "[_-](?:s|strength)([0-9]+(?:\\.[0-9]+)?)", 1).try_cast("double")
    return F.when(~path.rlike("/(compare|_work)/") & ~name.startswith("._"), F.struct(kind.alias("kind"), name.alias("name"), strength.alias("strength")))


def find(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, kind, name, strength, size, modified) of files below path, sorted by path; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return found.select("path", "length", "modificationTime", classify(F.col("path")).alias("c")).where("c is not null").select("path", "c.*", F.col("length").alias("size"), F.col("modificationTime").alias("modified")).orderBy("path")


def missing(wanted: DataFrame, cache: DataFrame, content: str = "content") -> DataFrame:
    """Rows of wanted whose content has no entry in the cache, with its key (SHA-1 of the bytes)."""
    return wanted.withColumn("key", F.sha1(F.col(content).cast("binary"))).join(cache.select("key").distinct(), "key", "left_anti")
