"""Binary sources and dimensions: MIDI notes, PCM audio as frames, JSON dimensions, cached lyrics; model boundaries with a stage log."""

from __future__ import annotations

import io
import struct
import traceback
import wave
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NOTES = "path string, track int, program int, drums boolean, start double, end double, pitch int, vel int"


class Reader:
    """Big-endian numbers and variable lengths from bytes."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        out = self.data[self.at : self.at + n]
        if len(out) != n:
            raise ValueError("the file is cut short")
        self.at += n
        return out

    def size(self) -> int:
        value = 0
        while True:
            byte = self.take(1)[0]
            value = value << 7 | byte & 0x7F
            if byte < 0x80:
                return value


def midi_events(data: bytes) -> tuple[int, list[list[tuple[int, int, bytes]]]]:
    """(ticks a quarter note, tracks of (tick, status, data)) of a standard MIDI file; tempo changes have the status 0x51."""
    head = Reader(data)
    if head.take(4) != b"MThd":
        raise ValueError("no MIDI file")
    length, _, n, division = struct.unpack(">IHHH", head.take(10))
    head.take(length - 6)
    tracks = []
    for _ in range(n):
        if head.take(4) != b"MTrk":
            raise ValueError("no track where one should begin")
        r, tick, status, out = Reader(head.take(struct.unpack(">I", head.take(4))[0])), 0, 0, []
        while r.at < len(r.data):
            tick += r.size()
            first = r.take(1)[0]
            if first == 0xFF:
                kind, body = r.take(1)[0], r.take(r.size())
                if kind == 0x51:
                    out.append((tick, 0x51, body))
            elif first in (0xF0, 0xF7):
                r.take(r.size())
            else:
                # a data byte repeats the status before it
                status, rest = (first, b"") if first & 0x80 else (status, bytes([first]))
                want = 1 if status >> 4 in (0xC, 0xD) else 2
                out.append((tick, status, rest + r.take(want - len(rest))))
        tracks.append(out)
    return division, tracks


def midi_notes(data: bytes) -> Iterator[tuple]:
    """(track, program, drums, start, end, pitch, vel) in seconds, sorted within a track; channel 10 is drums. A note that is
    never released ends with its track."""
    division, tracks = midi_events(data)
    tempo = sorted((tick, int.from_bytes(body, "big") / 1e6) for events in tracks for tick, status, body in events if status == 0x51)
    points = [(0, 0.0, 0.5)]
    for tick, quarter in tempo:
        at, seconds, before = points[-1]
        points.append((tick, seconds + (tick - at) * before / division, quarter))
    ticks = np.array([p[0] for p in points])

    def when(tick: int) -> float:
        at, seconds, quarter = points[int(np.searchsorted(ticks, tick, "right")) - 1]
        return seconds + (tick - at) * quarter / division

    for number, events in enumerate(tracks):
        program, held, found = {}, {}, []
        for tick, status, body in [*events, (events[-1][0] if events else 0, 0, b"")]:
            kind, channel = status >> 4, status & 15
            if kind == 0xC:
                program[channel] = body[0]
            elif kind in (8, 9):
                pitch, vel = body
                if (channel, pitch) in held:
                    start, loud, own = held.pop((channel, pitch))
                    found.append((number, own, channel == 9, when(start), when(tick), pitch, loud))
                if kind == 9 and vel:
                    held[channel, pitch] = (tick, vel, program.get(channel, 0))
        last = events[-1][0] if events else 0
        found += [(number, own, c == 9, when(start), when(last), p, loud) for (c, p), (start, loud, own) in held.items()]
        yield from sorted(found, key=lambda x: x[3:])


def read_midi(spark: SparkSession, path: str, glob: str = "*.mid") -> DataFrame:
    """The notes of MIDI files, in Arrow batches; a file that can't be read gives no rows but a warning by `unreadable`."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                rows = [(name, *r) for r in midi_notes(bytes(content))]
                yield pd.DataFrame(rows, columns=["path", "track", "program", "drums", "start", "end", "pitch", "vel"])

    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return found.select("path", "content").mapInPandas(run, NOTES)


def tracks_of(notes: DataFrame, classes: DataFrame) -> DataFrame:
    """Notes with class and inst: drums by their flag, others by program in classes (class, inst, programs), else piano.
    Tracks of one instrument are one: it takes the class of its first track."""
    by_program = classes.select(F.explode("programs").alias("program"), F.col("class").alias("_c"))
    named = notes.join(F.broadcast(by_program), "program", "left").withColumn("class", F.when(F.col("drums"), "drums").otherwise(F.coalesce("_c", F.lit("piano")))).drop("_c")
    placed = named.join(F.broadcast(classes.select("class", "inst")), "class", "left")
    first = placed.groupBy("path", "inst").agg(F.min_by("class", "track").alias("class"))
    return placed.drop("class").join(first, ["path", "inst"])


def wav_frames(data: bytes, frame: float) -> tuple[int, np.ndarray]:
    """(rate, RMS of the mono mix by frame) of a PCM file; a mono file is its own mix, a last frame cut short goes."""
    with wave.open(io.BytesIO(data)) as w:
        rate, channels, width = w.getframerate(), w.getnchannels(), w.getsampwidth()
        raw = w.readframes(w.getnframes())
    if width == 3:
        x = np.frombuffer(raw, "u1").reshape(-1, 3).astype("i4")
        samples = ((x[:, 0] << 8 | x[:, 1] << 16 | x[:, 2] << 24) >> 8) / float(1 << 23)
    else:
        samples = (np.frombuffer(raw, "u1") / 128.0 - 1) if width == 1 else np.frombuffer(raw, f"<i{width}") / float(1 << (8 * width - 1))
    mono = samples.reshape(-1, channels).mean(axis=1)
    n = max(int(round(rate * frame)), 1)
    return rate, np.sqrt((mono[: len(mono) // n * n].reshape(-1, n) ** 2).mean(axis=1)) if len(mono) >= n else np.zeros(0)


def read_audio(spark: SparkSession, path: str, frame: float = 0.1, glob: str = "*.wav") -> DataFrame:
    """(path, rate, frame, t, rms) of PCM files, frames of `frame` seconds."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                rate, rms = wav_frames(bytes(content), frame)
                yield pd.DataFrame({"path": name, "rate": rate, "frame": np.arange(len(rms)), "t": np.arange(len(rms)) * frame, "rms": rms})

    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return found.select("path", "content").mapInPandas(run, "path string, rate int, frame long, t double, rms double")


def read_dimension(spark: SparkSession, path: str, value: str, keys: tuple[str, ...] = ("key",)) -> DataFrame:
    """A JSON file of nested objects as rows: a column for each level of keys, then the struct's columns (value: its DDL).
    Dimensions are small files, read whole."""
    kind = f"struct<{value}>"
    for _ in keys:
        kind = f"map<string,{kind}>"
    out = spark.read.text(path, wholetext=True).select(F.from_json("value", kind).alias("_v"))
    for i, key in enumerate(keys):
        out = out.select(*keys[:i], F.explode("_v").alias(key, "_v"))
    return out.select(*keys, "_v.*")


def cached_lyrics(wanted: DataFrame, cache: DataFrame, by: list[str]) -> DataFrame:
    """wanted with what the cache (by, record) holds: lyrics, and known: whether it was ever looked up. An empty record is a
    lookup that found nothing, so it isn't asked for again."""
    got = cache.select(*by, F.get_json_object("record", "$.syncedLyrics").alias("_s"), F.get_json_object("record", "$.plainLyrics").alias("_p"), F.lit(True).alias("known"))
    return wanted.join(got, by, "left").withColumn("lyrics", F.coalesce(F.nullif("_s", F.lit("")), F.nullif("_p", F.lit("")))).withColumn("known", F.coalesce("known", F.lit(False))).drop("_s", "_p")


class Boundary(NamedTuple):
    """Where a model is plugged in: what it is called with and what it has to give, as DDL."""

    takes: str
    gives: str


#: The model boundaries. The engine ships no model: precomputed tables of these shapes, or a function for run_model, go in.
BOUNDARIES = {
    "separate": Boundary("path string, content binary", "path string, label string, stem_path string"),
    "transcribe": Boundary("path string, content binary", NOTES),
    "notes": Boundary("path string, content binary", "path string, start double, end double, hz double, amp double"),
    "f0": Boundary("path string, content binary", "path string, t double, hz double, periodicity double"),
    "embed": Boundary("path string, content binary", "path string, frame_no long, v array<float>"),
    "words": Boundary("path string, content binary", "path string, start double, end double, word string, prob double"),
    "speaker": Boundary("path string, content binary, other binary", "path string, similarity double"),
    "features": Boundary("path string, content binary", "path string, feature string, frame_no long, t double, v double"),
    "refine": Boundary("path string, pitch int, vel int", "path string, class string, prob double"),
    "command": Boundary("path string, arguments array<string>", "path string, code int, output string"),
}


def run_model(df: DataFrame, name: str, model: Callable[[dict], list[tuple]]) -> tuple[DataFrame, DataFrame]:
    """Runs a model over the rows of df: what it gives, and the stage log (path, ok, rows, error). A row on which it fails has
    an entry in the log and no output; the others go on."""
    takes, gives = BOUNDARIES[name]
    columns = [c.strip().split(" ")[0] for c in gives.split(", ")]
    asked = [c.strip().split(" ")[0] for c in takes.split(", ")]
    shape = f"path string, ok boolean, error string, found array<struct<{', '.join(':'.join(c.split(' ', 1)) for c in gives.split(', '))}>>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                try:
                    out.append((row["path"], True, None, [dict(zip(columns, x, strict=True)) for x in model(row)]))
                except Exception:  # noqa: BLE001 - a model's failure is a row of the log
                    out.append((row["path"], False, traceback.format_exc().strip().splitlines()[-1], []))
            yield pd.DataFrame(out, columns=["path", "ok", "error", "found"])

    from .files import staged

    told = staged(df.select(*asked).mapInPandas(run, shape), name)
    return told.select(F.explode("found").alias("x")).select("x.*"), told.select("path", "ok", F.size("found").cast("long").alias("rows"), "error")


def manifest(stems: DataFrame, by: list[str]) -> DataFrame:
    """(by, json): the separation's manifest of stems (by, stem, path, level): what is there and its levels, null for silence."""
    level = F.when(~F.isnan("level") & (F.abs("level") != float("inf")), F.col("level"))
    entries = lambda v: F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col("stem").alias("key"), v.alias("value")))))
    told = stems.groupBy(*by).agg(entries(F.col("path")).alias("stems"), entries(level).alias("levels_db"))
    return told.select(*by, F.to_json(F.struct("stems", "levels_db"), {"ignoreNullFields": "false"}).alias("json"))


def vocals_of(lead_db: Column, backing_db: Column) -> Column:
    """Which stem to transcribe: both voices together where the lead is 20 dB below the backing, else the lead."""
    return F.when(lead_db < backing_db - 20, "vocals").otherwise("lead_vocals")


def with_fx(lines: DataFrame, fx: DataFrame, by: list[str]) -> DataFrame:
    """Stream lines (by, stem, pos, line) with the production line of their stem (stem, line) before the first one (pos -1);
    it is measured once a stem."""
    first = lines.where("stem is not null").select(*by, "stem").distinct().join(fx.withColumnRenamed("line", "_line"), "stem")
    return lines.unionByName(first.select(*by, "stem", F.lit(-1).cast(lines.schema["pos"].dataType).alias("pos"), F.col("_line").alias("line")))
