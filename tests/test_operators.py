"""Operators on small literal rows."""

import random
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from eventscore.functions import pitch
from eventscore.operators import align, folds, joins, series
from eventscore.plans.base import events
from eventscore.sources import sc
from eventscore.streaming.windows import counts, streamed_counts


def test_matching_is_maximal():
    rng = random.Random(3)
    for _ in range(200):
        n, m = rng.randint(0, 6), rng.randint(0, 6)
        links = [[j for j in range(m) if rng.random() < 0.4] for _ in range(n)]

        def best(i, used):
            return 0 if i == n else max([best(i + 1, used), *(1 + best(i + 1, used | {j}) for j in links[i] if j not in used)])

        assert joins.most_pairs(links, m) == best(0, frozenset())


def test_match_counts(spark):
    a = spark.createDataFrame([(1, 0.0), (1, 1.0), (1, 50.0), (2, 5.0)], "k int, t double")
    b = spark.createDataFrame([(1, 0.5), (1, 0.6), (3, 5.0)], "k int, t double")
    got = {r["k"]: (r["n_left"], r["n_right"], r["n_matched"], r["f1"]) for r in joins.match_counts(a, b, ["k"], "t", 1.0).collect()}
    assert got == {1: (3, 2, 2, 0.8), 2: (1, 0, 0, 0.0), 3: (0, 1, 0, 0.0)}


def brute_matching(a, b, tol, tol2=None):
    links = [[j for j, y in enumerate(b) if abs(x[0] - y[0]) <= tol and (tol2 is None or abs(x[1] - y[1]) <= tol2)] for x in a]
    return joins.most_pairs(links, len(b))


def test_match_counts_by_brute_force(spark):
    rng = random.Random(8)
    rows = [(k, s, round(rng.random() * 30, 2), rng.random() * 5) for k in range(6) for s in (0, 1) for _ in range(rng.randint(0, 40))]
    df = spark.createDataFrame(rows, "k int, s int, t double, v double")
    for other in (None, "v"):
        got = {r["k"]: r["n_matched"] for r in joins.match_counts(df.where("s = 0"), df.where("s = 1"), ["k"], "t", 0.4, other, 1.0).collect()}
        for k, n in got.items():
            a, b = ([(t, v) for q, z, t, v in rows if q == k and z == side] for side in (0, 1))
            assert n == brute_matching(a, b, 0.4, 1.0 if other else None)


def test_segments(spark):
    notes = [(1, float(i), i + 0.875) for i in range(30)] + [(2, 0.0, 4.0), (2, 9.0, 9.5), (3, 0.0, 1.0), (3, 1.1, 9.0), (3, 9.05, 17.0)]
    got = {}
    for r in folds.segments(spark.createDataFrame(notes, "k int, a double, b double"), ["k"], "a", "b", 0.0, 40.0, 15.0, 0.3, 1.0).collect():
        got.setdefault(r["k"], []).append((r["segment"], round(r["a"], 3), round(r["b"], 3)))
    # no rest of 0.3: the last of the widest rests before a note reaches beyond 15; then pieces of 15
    assert sorted(got[1])[0] == (0, 0.0, 14.938)
    assert all(b - a <= 15 + 1e-9 for spans in got.values() for _, a, b in spans) and all(sorted(s)[0][1] == 0 and sorted(s)[-1][2] == 40 for s in got.values())
    assert all(x[2] == y[1] for s in got.values() for x, y in zip(sorted(s), sorted(s)[1:]))
    assert sorted(got[3])[0] == (0, 0.0, 1.05)


def test_names_already_taken(spark):
    df = spark.createDataFrame([(1, 1, "x", "a"), (1, 2, "x", "a"), (1, 3, "x.a", "b"), (1, 4, "x", "a"), (1, 5, "x.a2", "c")], "g int, i int, name string, stem string")
    assert [r["unique"] for r in folds.unique_names(df, ["g"], "name", "stem", "i").orderBy("i").collect()] == ["x", "x.a", "x.a.b", "x.a2", "x.a2.c"]


def test_asof_takes_equal_times_unless_strict(spark):
    a = spark.createDataFrame([(1, 2.0), (1, 0.5)], "k int, t double")
    b = spark.createDataFrame([(1, 1.0, "x"), (1, 2.0, "y")], "k int, t double, v string")
    read = lambda **how: sorted((r["t"], r["o"]) for r in joins.asof_join(a, b, ["k"], "t", F.col("v"), "o", **how).collect())
    assert read() == [(0.5, None), (2.0, "y")]
    assert read(strict=True) == [(0.5, None), (2.0, "x")]
    assert read(forward=True) == [(0.5, "x"), (2.0, "y")]


def test_sliding_ends_at_the_duration(spark):
    assert [tuple(r) for r in series.sliding(spark, 20, 10, 45).collect()] == [(0, 0.0, 20.0), (1, 10.0, 30.0), (2, 20.0, 40.0), (3, 30.0, 45.0)]
    assert [tuple(r) for r in series.sliding(spark, 20, 10, 5).collect()] == [(0, 0.0, 5.0)]


def test_pitches(spark):
    texts = [("A3+8", 5708.0), ("A4c", 6900.0), ("C-1", None), ("440Hz", None), ("~440hz", 6900.0), ("A4", 6900.0), ("C4", 6000.0), ("A3+8c", 5708.0), ("F1-6c", 2894.0), ("~440.0Hz", 6900.0), ("5708c", 5708.0), ("?", None)]
    df = spark.createDataFrame([t for t, _ in texts], "string").select(pitch.parse_pitch(F.col("value")).alias("c"))
    assert [r["c"] for r in df.collect()] == [c for _, c in texts]
    assert [r[0] for r in spark.createDataFrame([5708.0, 2894.0, 6900.0, 6950.0, 50.0], "double").select(pitch.cents_name(F.col("value"))).collect()] == ["A3+8c", "F1-6c", "A4", "A#4-50c", "C-1+50c"]
    roots = spark.createDataFrame(["Am", "C", "F", "N", "Cb", "E#"], "string").select(pitch.chord_root(F.col("value")).alias("c"))
    assert [r["c"] for r in roots.collect()] == [3300.0, 3600.0, 2900.0, None, None, None]


def test_document_parts():
    assert sc.balanced('a "{" {b}') and not sc.balanced("a {b")
    assert list(sc.fold_lines("# c\na {\n b }\n\n  x")) == [(2, "a { b }", False), (5, "x", True)]
    assert sc.split_tokens('a {b c} "d e" f') == ["a", "{b c}", '"d e"', "f"]
    assert [sc.parse_time(x) for x in ("@1.5", "3:2.5", "2", "x")] == [(None, None, 1.5), (3, 2.5, None), (None, 2.0, None), None]
    assert [r["kind"] for r in sc.parse_document("d", ":notes.x\n99999999999:1 A4\n1:1 C4")] == ["stream", "error"] and [r["kind"] for r in sc.parse_document("d", ":notes.x\nbars 1-99999999999 p")] == ["stream", "error"]
    assert len(list(sc.fold_lines("a {\n" + "b\n" * 20000 + "}"))) == 1
    # two events at a line break within a pattern fuse: the second one's atom is lost
    rows = list(sc.parse_document("d", ":notes.x\n%pat p { 1 C4 80\n 2 E4 | 3 G4 }\n:later.kind  odd=yes\n@2.5 thing 17\n"))
    assert [r["event"]["atom"] for r in rows if r["kind"] == "pattern"] == ["C4", "G4"]
    assert [r["stream"] for r in rows if r["kind"] == "event"] == ["later.kind"]


def test_alignment():
    a, b = "walk me down to the harder yeah".split(), "walk me down to the harbor".split()
    assert align.blocks(a, b) == [tuple(m) for m in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks() if m.size]
    assert align.word_distance(a, b) == 2


def test_folds(spark):
    df = spark.createDataFrame([(1, 0.0, 2.0, 60.0), (1, 1.0, 3.0, 90.0), (1, 5.0, 6.0, 61.0)], "k int, a double, b double, p double")
    assert sorted(tuple(r) for r in folds.monophonic(df, ["k"], "a", "b", "p", 10.0).collect()) == [(1, 0.0, 2.0, 60.0), (1, 5.0, 6.0, 61.0)]
    peaks = spark.createDataFrame([(1, 0.0, 1.0), (1, 2.0, 5.0), (1, 9.0, 1.0)], "k int, t double, s double")
    assert sorted(r["t"] for r in folds.spaced_peaks(peaks, ["k"], "t", "s", 5.0).collect()) == [2.0, 9.0]


def test_merging_keeps_the_loudest_and_the_first(spark):
    df = spark.createDataFrame([(1, 0.0, 1.0, 0.2, 7), (1, 1.02, 2.0, 0.9, 8), (1, 5.0, 6.0, 0.1, 9)], "p int, a double, b double, amp double, bend int")
    got = series.merge_intervals(df, ["p"], "a", "b", 0.03, [], most=["amp"], first=["bend"]).orderBy("a").collect()
    assert [(r["a"], r["b"], r["n"], r["amp"], r["bend"]) for r in got] == [(0.0, 2.0, 2, 0.9, 7), (5.0, 6.0, 1, 0.1, 9)]


def test_stream_equals_batch(spark):
    path = "/root/testdata/sf0.001/events.parquet"
    batch = counts(spark.read.parquet(path).withColumn("ts", F.col("ts").cast("timestamp")))
    assert sorted(map(tuple, streamed_counts(spark, path).collect())) == sorted(map(tuple, batch.collect()))


def test_empty_tables(spark):
    e = events(spark, "/root/testdata/sf0.001").limit(0)
    assert joins.nearest_join(e, e, ["user_id"], "t", "event_id", "x").count() == 0
    assert series.merge_intervals(e.withColumn("b", F.col("t")), ["user_id"], "t", "b", 1.0, ["event_id"]).count() == 0
