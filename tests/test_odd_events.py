"""Queries over events against their SQL where values are zero, negative or missing, and where the order of a sum tells."""

import datetime

import duckdb
import pytest

from eventscore.plans.catalog import ORACLES, QUERIES

T0 = datetime.datetime(2024, 1, 1)


def both(spark, at, name, rows, parts=1):
    """The query's rows and its SQL's; rows are (event_id, seconds, user_id, event_type, value), stored in this order."""
    made = [(i, T0 + datetime.timedelta(seconds=t), u, what, v, "{}") for i, t, u, what, v in rows]
    df = spark.createDataFrame(made, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    df.coalesce(1).write.parquet(f"{at}/one")
    if parts == 1:
        df.coalesce(1).write.parquet(f"{at}/events.parquet")
    else:
        df.repartition(parts).write.parquet(f"{at}/events.parquet")
    c = duckdb.connect()
    c.sql("set threads = 1")
    c.sql(f"create view events as select * from '{at}/one/*.parquet'")
    got = QUERIES[name](spark, str(at))
    cols = sorted(got.columns)
    want = c.sql(ORACLES[name]).project(", ".join(f'"{x}"' for x in cols)).fetchall()
    return sorted(map(repr, (tuple(r) for r in got.select(*cols).collect()))), sorted(map(repr, want))


@pytest.mark.parametrize("value", [0.0, -3.0])
def test_decay_of_hits_without_a_positive_peak(spark, tmp_path, value):
    rows = [(0, 10, 1, "purchase", value), (1, 100, 1, "purchase", 8.0), (2, 160, 1, "view", 1.0), (3, 5, 2, "purchase", value), (4, 9, 3, "purchase", None)]
    got, want = both(spark, tmp_path, "agg26_hit_decay", rows)
    assert got == want and len(got) == 2


def test_decay_at_a_half_of_the_last_place(spark, tmp_path):
    rows = [(0, 399117.076247, 1, "purchase", 8.0), (1, 471364.835297, 1, "view", 1.0)]
    got, want = both(spark, tmp_path, "agg26_hit_decay", rows)
    assert got == want == ["(72247.759, 1, 1)"]


def test_sums_go_by_the_events_order(spark, tmp_path):
    values = [0.1, 0.2, 0.3, 1e3, 0.7, 0.2, 1e6, -1e6, 500.0, 0.7, 0.1, 0.2]
    rows = [(i, 10 * i, u, "view", (values[u:] + values[:u])[k]) for i, (k, u) in enumerate((k, u) for k in range(12) for u in range(12))]
    got, want = both(spark, tmp_path, "scl11_labels", rows, parts=7)
    assert got == want


def test_labels_of_missing_names_and_times(spark, tmp_path):
    rows = [(0, 10, 1, None, 3.0), (1, 70, None, "view", 4.0), (2, -30, 2, "view", None), (3, -3600, 3, "view", 1500.5)]
    got, want = both(spark, tmp_path, "scl11_labels", rows)
    assert got == want and len(got) == 4


def test_marks_of_zero_negative_and_missing_values(spark, tmp_path):
    rows = [(0, 1, 1, "view", 0.0), (1, 2, 1, "view", 5.0), (2, 3, 1, "view", -2.0), (3, 4, 1, "view", None), (4, 5, 2, "view", 0.0), (5, 6, 3, "view", -1.0), (6, 7, 3, "view", -4.0), (7, 8, None, "view", 3.0), (8, 9, 4, "view", None)]
    got, want = both(spark, tmp_path, "scl20_marks", rows)
    assert got == want and len(got) == 8
