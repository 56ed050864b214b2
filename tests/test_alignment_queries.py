"""jon15_align and srt7_best_offset over whole tables: long pairs, altered words, short passages."""

from eventscore.plans.catalog import QUERIES


def tables(spark, at, docs, items):
    spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at)


def test_long_documents_are_aligned(spark, tmp_path):
    long = " ".join(f"w{i}" for i in range(5000))
    d = tables(spark, tmp_path, ["w0 w1 w2 w3", long], ["x"])
    assert [tuple(r)[:4] for r in QUERIES["jon15_align"](spark, d).collect()] == [(1, 0, 4, 4)]


def test_places_with_an_altered_seed_and_short_passages(spark, tmp_path):
    words = [f"v{i}" for i in range(20)]
    altered = ["a", "b", *words[:3], "other", *words[4:], "c"]
    d = tables(spark, tmp_path, [" ".join(altered), "p q r s one two x four y"], [" ".join(words), "one two three four"])
    got = {r["item_id"]: tuple(r)[1:] for r in QUERIES["srt7_best_offset"](spark, d).collect()}
    assert got == {0: (0, 3, 0.95), 1: (1, 5, 0.75)}
