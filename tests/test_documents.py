"""Documents: parsing, time base, expansion, and what is written and read beside tables."""

import math

import pytest
from pyspark.sql import functions as F

from eventscore.operators import expand, timebase
from eventscore.plans.document_queries import SAMPLE
from eventscore.sources import files, sc


def parsed(spark, *texts):
    return sc.parse_documents(spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "doc_id string, text string"))


def kinds(text):
    return [(r["kind"], r["name"], r["args"]) for r in sc.parse_document("d", text)]


def test_events():
    e = sc.parse_event('3:1.5 C#4 0.5b 90 dev-12.5ms ?0.7 alt="D4" env{ a 2ms } odd')
    assert (e["bar"], e["beat"], e["atom"], e["dur"], e["vel"], e["dev"], e["conf"], e["alt"], e["blocks"]) == (3, 1.5, "C#4", "0.5b", 90, -12.5, 0.7, "D4", {"env": "a 2ms"})
    assert [sc.parse_event('1 "a b" 2s')[k] for k in ("beat", "text", "dur", "atom", "vel")] == [1.0, "a b", "2s", None, None]
    assert sc.parse_event("1 ?0.5 77")["vel"] == 77
    with pytest.raises(ValueError):
        sc.parse_event("x C4")


def test_bindings():
    b = sc.parse_binding("bars 5-7 like 1-2 x3 transpose 2 vel -8 ~0.91")
    assert [b[k] for k in ("first", "last", "like_first", "like_last", "repeat", "transpose", "vel", "similarity")] == [5, 7, 1, 2, 3, 2, -8, 0.91]
    assert sc.parse_binding("bars 1-2 Am | F")["chords"] == ["Am", "F"]
    assert sc.parse_binding("bars 3 G")["pattern"] == "G"


def test_lines():
    assert kinds("%sc 0.3\n@a  \"b\"\nlost\n:x.y inst=k loose\n  env{ a }\n@1 z\n%late 1") == [
        ("pragma", "sc", ["0.3"]), ("header", "a", ["b"]), ("stream", "x.y", ["inst=k", "loose"]), ("field", "inst", ["k"]), ("unknown", "loose", None), ("block", "env", ["a"]), ("event", None, None), ("pragma", "late", ["1"]),
    ]
    assert kinds(":x\nmeta src=a warn=\"b c\"\n!auto g 1:1 0.5 -> 2:1 1")[1:] == [("meta", "src", ["a"]), ("warn", "warn", ["b c"]), ("auto", "g", ["1:1", "0.5", "2:1", "1.0"])]
    assert [k for k, *_ in kinds(":x\n1:1 C4\nbars x y\n1:2 C4")] == ["stream", "event", "error"]
    assert kinds("") == []
    assert kinds(':a ~"g h" n{ x 1 } k="v w"\n~"no"')[1:4] == [("gloss", None, ["g h"]), ("block", "n", ["x 1"]), ("field", "k", ["v w"])]
    assert [k for k, *_ in kinds(":x\n%pat p 1 C4")] == ["stream", "error"] and [k for k, *_ in kinds(":x\n!auto g 1:1 0.5 -> z 1")] == ["stream", "error"]


def reference_time(tempo, t0, beats, steps=200_000):
    """Seconds after which beats have passed from t0, by small steps."""

    def bpm(t):
        for (a, x), (b, y) in zip(tempo, tempo[1:], strict=False):
            if a <= t <= b:
                return x + (y - x) * (t - a) / (b - a)
        return tempo[0][1] if t < tempo[0][0] else tempo[-1][1]

    t, dt, done = t0, 20 / steps, 0.0
    while done < beats:
        done += dt * bpm(t + dt / 2) / 60
        t += dt
    return t


def test_time_base(spark):
    tempo = [(0.0, 120.0), (8.0, 120.0), (16.0, 96.0)]
    got = {r["bar"]: r["start"] for r in timebase.bar_starts(parsed(spark, SAMPLE), 9).where("doc_id = '0'").collect()}
    assert got[1] == 0.0 and got[5] == 8.4
    scale = 8.4 / reference_time(tempo, 0.0, 16)
    assert got[3] == pytest.approx(reference_time(tempo, 0.0, 8) * scale, abs=1e-3)
    assert got[9] == pytest.approx(reference_time(tempo, 8.4, 16), abs=1e-3)


def test_meters_and_defaults(spark):
    got = [r["start"] for r in timebase.bar_starts(parsed(spark, ":grid\nmeter @0 4/4\nmeter @4 6/8\ntempo @0 60"), 4).orderBy("bar").collect()]
    assert got == [0.0, 4.0, 7.0, 10.0]
    assert [r["start"] for r in timebase.bar_starts(parsed(spark, ":notes.x\n1:1 C4"), 3).orderBy("bar").collect()] == [0.0, 2.0, 4.0]
    early = [r["start"] for r in timebase.bar_starts(parsed(spark, ":grid\nanchor bar 3 @1.0"), 4).orderBy("bar").collect()]
    assert early == [1.0, 1.0, 1.0, 3.0]


def test_expansion(spark):
    notes = expand.expand(parsed(spark, SAMPLE)).orderBy("start", "stream_pos", *expand.ORDER).collect()
    by = lambda s: [n for n in notes if n["stream"] == s]
    # two events at a line break within the pattern fuse, so it has 3 hits a bar
    assert len(by("perc.drums")) == 2 * 3 + 1 and by("perc.drums")[0]["voice"] == "kick" and by("perc.drums")[0]["start"] == pytest.approx(0.01)
    # bar 7 has a single chord, read as a pattern, so its roots and bar 8's go; bars 3 to 6 reuse 1 and 2 in turn
    roots = [n["cents"] for n in by("notes.bass")]
    assert roots == [3300.0, 3300.0, 2900.0, 2900.0] * 3 and {n["vel"] for n in by("notes.bass")} == {108, 90}
    lead = by("notes.lead")
    assert sorted(n["vel"] for n in lead) == [1, 1, 2, 2, 58, 62, 90, 90]
    assert [n["vib"] for n in lead if n["vib"]] == [{"rate": 5.4, "depth": 31.0, "onset": 0.22}]
    assert [(n["dur"], n["env"]) for n in lead if n["start"] == 4.0] == [(0.02, {"a": 0.021, "s": 0.68})]
    assert [n["dur"] for n in lead if n["start"] == 3.0] == [0.5]
    assert expand.expand(parsed(spark, "", ":notes.x")).count() == 0


def test_number_lines(spark):
    df = spark.createDataFrame([("a", i / 50, 5700.0 + i) for i in range(120)], "doc_id string, t double, v double")
    lines = files.number_lines(df, ["doc_id"], "t", "v").withColumn("stream_pos", F.lit(0))
    assert [len(r["line"].split()) - 2 for r in lines.orderBy("pos").collect()] == [50, 50, 20]
    streams = spark.createDataFrame([("a", 0, "contour.x", None, None), ("a", 1, "text.x", None, "no voice")], "doc_id string, stream_pos int, head string, meta string, omitted string")
    text = files.documents(streams, lines)
    assert text.first()["text"].endswith("# :text.x omitted — no voice")
    back = files.number_rows(sc.parse_documents(text)).orderBy("t").collect()
    assert [r["value"] for r in back] == [5700.0 + i for i in range(120)] and back[70]["t"] == pytest.approx(1.4)


def test_json_and_tables(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.5), ("b", math.nan), ("c", math.inf), ("d", None)], "k string, x double")
    assert [r[0] for r in df.select(files.to_json(F.struct("k", files.finite(F.col("x")).alias("x")))).collect()] == ['{"k":"a","x":1.5}', '{"k":"b","x":null}', '{"k":"c","x":null}', '{"k":"d","x":null}']
    assert df.select(files.fixed_width({"k": 3, "x": 4}, left=("k",))).first()[0] == "a     1.5"
    for _ in range(2):
        files.replace(df.select("k"), f"file://{tmp_path}/report")
    assert files.read_history(spark, f"file://{tmp_path}/report", "k string").count() == 4
    (tmp_path / "report").rename(tmp_path / "report.old")
    files.recover(spark, f"file://{tmp_path}/report")
    assert files.read_history(spark, f"file://{tmp_path}/report", "k string").count() == 4
    for part in ("k in ('b', 'a')", "k = 'd'", "k = 'c'"):
        files.append_history(df.select("k").where(part), f"file://{tmp_path}/runs")
    assert [r["k"] for r in files.read_history(spark, f"file://{tmp_path}/runs", "k string").orderBy("seq").collect()] == ["a", "b", "d", "c"]


def test_lines_end_at_gaps(spark):
    df = spark.createDataFrame([("a", i / 50, 100.0 + i) for i in [*range(10), *range(20, 90)]], "doc_id string, t double, v double")
    lines = files.number_lines(df, ["doc_id"], "t", "v").withColumn("stream_pos", F.lit(0))
    streams = spark.createDataFrame([("a", 0, "contour.x", None, None)], "doc_id string, stream_pos int, head string, meta string, omitted string")
    back = files.number_rows(sc.parse_documents(files.documents(streams, lines))).collect()
    assert sorted((round(r["t"], 3), r["value"]) for r in back) == [(round(r["t"], 3), r["v"]) for r in df.orderBy("t").collect()]


def test_found_files(spark, tmp_path):
    for name in ("a.sc", "stems/b_s0.5.wav", "._c.wav", "compare/d.wav"):
        at = tmp_path / name
        at.parent.mkdir(exist_ok=True)
        at.write_text("x")
    found = files.find(spark, f"file://{tmp_path}").collect()
    assert [(r["kind"], r["name"], r["strength"], r["size"]) for r in found] == [("document", "a.sc", None, 1), ("stem", "b_s0.5.wav", 0.5, 1)]
    wanted = spark.createDataFrame([("x",), ("y",)], "content string")
    cache = wanted.where("content = 'x'").select(F.sha1("content").alias("key"))
    assert [r["content"] for r in files.missing(wanted, cache).collect()] == ["y"]
