"""Gates, structure, songs, binary sources and model boundaries on small literal rows."""

import json
import math
import random
import struct
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventscore.functions import music
from eventscore.operators import gates, songs, structure
from eventscore.sources import media


def midi(path):
    """Two tracks at 96 ticks a quarter: a tempo change after four quarters, a running status, drums, a note that hangs."""
    def track(*events):
        body = b"".join(events)
        return b"MTrk" + struct.pack(">I", len(body)) + body

    end = b"\x00\xff\x2f\x00"
    tempo = track(b"\x00\xff\x51\x03\x07\xa1\x20", b"\x83\x00\xff\x51\x03\x0f\x42\x40", end)
    notes = track(b"\x00\xc0\x04", b"\x00\x90\x3c\x50", b"\x60\x3c\x00", b"\x82\x20\x90\x40\x60", b"\x60\x80\x40\x00", b"\x00\x99\x24\x7f", b"\x60\x89\x24\x00", b"\x00\x90\x43\x10", b"\x60\xff\x01\x01x", end)
    path.write_bytes(b"MThd" + struct.pack(">IHHH", 6, 1, 2, 96) + tempo + notes)


def test_midi(spark, tmp_path):
    midi(tmp_path / "a.mid")
    rows = media.read_midi(spark, f"file://{tmp_path}").orderBy("start", "pitch").collect()
    # a quarter is 0.5 s up to tick 384 (2 s), then 1 s
    assert [(r["pitch"], round(r["start"], 3), round(r["end"], 3), r["program"], r["drums"], r["vel"]) for r in rows] == [
        (60, 0.0, 0.5, 4, False, 80), (64, 2.0, 3.0, 4, False, 96), (36, 3.0, 4.0, 0, True, 127), (67, 4.0, 4.0, 4, False, 16),
    ]
    classes = spark.createDataFrame([("electric_piano", "keys.ep", [4, 5]), ("piano", "keys.grand", [0]), ("drums", "drums.kit", [])], "class string, inst string, programs array<int>")
    assert {(r["pitch"], r["inst"]) for r in media.tracks_of(media.read_midi(spark, f"file://{tmp_path}"), classes).collect()} == {(60, "keys.ep"), (64, "keys.ep"), (67, "keys.ep"), (36, "drums.kit")}
    with pytest.raises(ValueError):
        list(media.midi_notes(b"RIFF"))


@pytest.mark.parametrize("width", [1, 2, 3, 4])
def test_audio(spark, tmp_path, width):
    rate, n = 8000, 4000
    x = 0.5 * np.sin(2 * np.pi * 100 * np.arange(n) / rate)
    top = (1 << (8 * width - 1)) - 1
    ints = np.round(x * top).astype("i8") + (128 if width == 1 else 0)
    with wave.open(str(tmp_path / "a.wav"), "wb") as w:
        w.setnchannels(2)
        w.setsampwidth(width)
        w.setframerate(rate)
        w.writeframes(b"".join(int(v).to_bytes(width, "little", signed=width > 1) * 2 for v in ints))
    rows = media.read_audio(spark, f"file://{tmp_path}").orderBy("frame").collect()
    assert len(rows) == 5 and rows[0]["rate"] == rate and all(r["rms"] == pytest.approx(0.5 / math.sqrt(2), abs=0.01) for r in rows)


def test_dimensions_and_lyrics(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"bass": {"f0": {"floor": 1, "ceiling": 2.5}}, "vocal": {"f0": {"floor": 3, "ceiling": 4, "axis": "what"}}}))
    rows = media.read_dimension(spark, f"file://{tmp_path}/a.json", "floor:double,ceiling:double,axis:string", ("part_type", "metric")).orderBy("part_type").collect()
    assert [tuple(r) for r in rows] == [("bass", "f0", 1.0, 2.5, None), ("vocal", "f0", 3.0, 4.0, "what")]
    cache = spark.createDataFrame([("a", '{"syncedLyrics": "[00:01.00] x", "plainLyrics": "x"}'), ("b", "{}"), ("c", '{"plainLyrics": "y"}')], "title string, record string")
    got = media.cached_lyrics(spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "title string"), cache, ["title"]).orderBy("title").collect()
    assert [(r["lyrics"], r["known"]) for r in got] == [("[00:01.00] x", True), (None, True), ("y", True), (None, False)]


def test_models_fail_softly(spark):
    def f0(row):
        if row["path"] == "bad":
            raise RuntimeError("no pitch here")
        return [(row["path"], 0.0, 440.0, 0.9), (row["path"], 0.02, 441.0, 0.8)]

    found, log = media.run_model(spark.createDataFrame([("a", bytearray(b"x")), ("bad", None)], "path string, content binary"), "f0", f0)
    assert [(r["path"], r["hz"]) for r in found.orderBy("t").collect()] == [("a", 440.0), ("a", 441.0)]
    assert [tuple(r) for r in log.orderBy("path").collect()] == [("a", True, 2, None), ("bad", False, 0, "RuntimeError: no pitch here")]
    assert all(b.gives.startswith("path string") for b in media.BOUNDARIES.values())


def test_production_lines(spark):
    eq = ",".join(["70"] + ["-3"] * 30)
    df = spark.createDataFrame([([f"eq={eq}", "rt60=9.5s", "wet=nan", "pan=-2", "width=0.4", "crest=12.5dB"],), (["eq=1,2", "rt60=x"],), ([],)], "args array<string>")
    a, b, c = (r["x"] for r in df.select(music.fx_values(F.col("args")).alias("x")).collect())
    assert a["eq"] == [60] + [-3] * 30 and (a["rt60"], a["wet"], a["pan"], a["width"], a["crest"]) == (4.0, None, -1.0, 0.4, 12.5)
    assert b["eq"] == [] and b["rt60"] is None and c["eq"] == []
    line = spark.range(1).select(music.fx_line(F.array(F.lit(1), F.lit(-2)), F.lit(0.5), F.lit(0.25), F.lit(0.0), F.lit(-0.1), F.lit(12.0))).first()[0]
    assert line == "fx      eq=1,-2  rt60=0.50s  wet=0.25  width=0.00  pan=-0.10  crest=12.0dB"


def test_positions_and_lines(spark):
    at = lambda t: spark.range(1).select(music.bar_beat(F.lit(t), F.lit(1.0), F.lit(2.0))).first()[0]
    assert [at(t) for t in (1.0, 1.5625, 3.0, 0.4)] == ["1:1.000", "1:2.125", "2:1.000", "@0.400"]
    line = lambda voice, cents, beats: spark.range(1).select(music.note_line(F.lit("1:2.125"), F.lit(voice), F.lit(cents), F.lit(beats), F.lit(88))).first()[0]
    assert line(None, 6000.0, 0.75) == "1:2.125  C4  0.750b 88" and line("clap", 0.0, 0.1) == "1:2.125 clap 88" and line(None, 6000.0, 0.001) == "1:2.125  C4  0.010b 88"


def test_boundaries_by_brute_force(spark):
    rng = random.Random(5)
    rows = [(k, b, rng.randint(0, 20) / 2) for k in range(5) for b in range(40)]
    got = {}
    for r in structure.boundaries(spark.createDataFrame(rows, "k int, bar long, s double"), ["k"], "bar", "s", 5).collect():
        got.setdefault(r["k"], set()).add(r["bar"])
    for k in range(5):
        taken = []
        for s, b in sorted((-s, b) for q, b, s in rows if q == k):
            if len(taken) < 5 and all(abs(b - x) >= 4 for x in taken):
                taken.append(b)
        assert got[k] == set(taken)


def test_keys(spark):
    rows = [("g", pc, v) for pc, v in enumerate(structure.MAJOR[-7:] + structure.MAJOR[:-7])] + [("am", pc, v) for pc, v in enumerate(structure.MINOR[-9:] + structure.MINOR[:-9])] + [("flat", pc, 1.0) for pc in range(12)] + [("few", 1, 2.0)]
    got = {r["k"]: (r["root"], r["mode"]) for r in structure.key_estimate(spark.createDataFrame(rows, "k string, pc int, v double"), ["k"], "pc", "v").collect()}
    assert got == {"g": (7, "major"), "am": (9, "minor")}


def test_gates_without_evidence(spark):
    f = spark.createDataFrame([("a", 0.0), ("a", 0.0), ("b", 1.0)], "k string, r double")
    assert {r["k"]: r["active"] for r in gates.active(f, ["k"], "r", frame_db=-50, share=0.1, whole_db=-60).collect()} == {"a": False, "b": True}
    env = spark.createDataFrame([("a", t / 10, v) for t, v in enumerate([0.0, 1.0, 0.5, 0.09, 0.01, 0.0, 2.0, 1.9, 1.8])], "k string, t double, v double")
    hits = spark.createDataFrame([("a", 0.05), ("a", 0.55)], "k string, t double")
    # the second hit never falls by 20 dB within its window
    assert [(r["decay"], r["hits"]) for r in gates.hit_decay(hits, env, ["k"], "t", "v", 1.0).collect()] == [(pytest.approx(0.2), 1)]


def test_song_scores_fall_back(spark):
    parts = spark.createDataFrame([("a", False, False, 80.0, 0.5), ("a", False, True, 60.0, 0.25), ("a", False, False, None, 0.25), ("a", True, False, 10.0, 5.0), ("b", True, False, 50.0, 1.0), ("c", False, False, 70.0, 1.0)], "song string, silent boolean, missing boolean, score double, energy double")
    mix = spark.createDataFrame([("a", False, 60.0), ("b", False, 30.0), ("c", True, 90.0), ("d", True, 1.0)], "song string, silent boolean, score double")
    assert {r["song"]: r["score"] for r in songs.song_scores(parts, mix, ["song"]).collect()} == {"a": 50.0, "b": 30.0, "c": 70.0, "d": None}


def test_changes_are_told(spark):
    df = spark.createDataFrame([(52.4, 61.0), (37.0, None), (10.0, 10.4)], "a double, b double").select(songs.change(F.col("a"), F.col("b")).alias("x"))
    assert [r["x"] for r in df.collect()] == ["52 → 61 (+9)", "37 → —", "10 → 10 (+0)"]
