"""Stores: postings, swaps that are cut off, counts that do not agree, broken tables; topics, periods, odd milliseconds."""

import os

import pytest
from pyspark.sql import functions as F

from arbolex.functions import scalars, stats
from arbolex.operators import logs, ranked, text, vector
from arbolex.session import recovered, swapped
from arbolex.sources import ingest, store
from arbolex.streaming import usage

from . import vocab


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("store") / "s")
    assert store.publish(store.stamped(vocab.vocabulary(spark), "2026-01-01", "test", 2), path)
    return path


def test_postings_give_what_a_scan_gives(spark, written):
    v = store.open_store(spark, written)
    assert set(v.postings) == set(store.INDEXES)
    rows = lambda df: sorted((r["notation"], round(r["rank"], 9)) for r in df.collect())
    for phrases in ([["angel", "with"]], [["trumpet"], ["the", "angel"]], [["beasts", "of", "prey"]], [["nothing"]], [["of", "of"]], []):
        for scope in (None, scalars.has_prefix("notation_lc", "73")):
            assert rows(ranked.search_postings(v.postings["label_index"], phrases, scope)) == rows(text.search(v.label_index, phrases, scope)), phrases
    plan = ranked.search_postings(v.postings["label_index"], [["angel"]])._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(token,angel)" in plan


def test_store_is_found_after_a_swap_was_cut_off(spark, tmp_path):
    path = str(tmp_path / "s")
    assert store.publish(vocab.vocabulary(spark), path)
    n = store.open_store(spark, path).notations.count()
    os.rename(path, path + ".old")  # the caller was lost between the two renames
    assert recovered(spark, path).endswith(".old") and store.open_store(spark, path).notations.count() == n
    assert store.publish(vocab.vocabulary(spark), path) and recovered(spark, path) == path
    assert not swapped(spark, str(tmp_path / "none"), path) and store.open_store(spark, path).notations.count() == n


def test_a_store_that_lacks_vectors_is_opened_without(spark, written, tmp_path):
    v = store.open_store(spark, written)
    assert store.metadata(v)["embedding_count"] == "4" and "embeddings" not in v.missing
    path = str(tmp_path / "s")
    store.write(store.stamped(v, "2026-01-02"), path)
    spark.read.parquet(f"{path}/embeddings").limit(3).write.parquet(f"{path}/few")
    assert swapped(spark, f"{path}/few", f"{path}/embeddings")
    assert "embeddings" in store.open_store(spark, path).missing
    with pytest.raises(Exception, match="dimensions"):
        vector.distances(v.embeddings, "notation", [1, 2, 3]).collect()


def test_broken_counters_are_a_fresh_start(spark, tmp_path):
    schema = "tool string, calls long"
    assert usage.read_written(spark, str(tmp_path / "none"), schema).count() == 0
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad/x.parquet").write_text("no parquet")
    assert usage.read_written(spark, str(tmp_path / "bad"), schema).count() == 0
    spark.range(3).write.parquet(str(tmp_path / "other"))
    assert usage.read_written(spark, str(tmp_path / "other"), schema).count() == 0


def test_topics_and_summaries(spark):
    rows = spark.createDataFrame(
        [("search", '{"query": "a", "parentNotation": "7"}'), ("search", '{"semanticQuery": "b", "maxResults": 30, "onlyWithArtworks": true}'), ("browse", "{}"), ("find_artworks", '{"notation": ["1", "2", "3", "4"]}'), ("resolve", '{"notation": "5"}'), ("health", '{"x": 1}')],
        "tool string, input string",
    )
    got = rows.select(logs.topics(F.col("tool"), F.col("input")).alias("t"), logs.input_summary(F.col("tool"), F.col("input")).alias("s"), logs.brief_input(F.col("tool"), F.col("input")).alias("b")).collect()
    assert [r["t"] for r in got] == [['query: "a"', "under: 7"], ['semantic: "b"'], [], ["artworks: [1, 2, 3...]"], [], []]
    assert [r["s"] for r in got] == ['query:"a", parentNotation:"7"', 'semanticQuery:"b", onlyWithArtworks, max:30', "?", "[1, 2, 3...] (n=4)", "5", '{"x": 1}']
    assert [r["b"] for r in got] == ['("a")', '("b")', "", "([1...] n=4)", "(5)", ""]


def test_odd_values(spark):
    ms = [r[0] for r in spark.createDataFrame([(x,) for x in ("NaN", "1e300", "-5.9", "x", None, "12.7")], "v string").select(scalars.whole_ms(F.col("v"))).collect()]
    assert ms == [0, 0, -5, 0, 0, 12]
    one = lambda c: spark.range(1).select(c).first()[0]
    key = lambda x: one(scalars.canonical_object(F.lit(x)))
    assert key('{"b": {"d": 1, "c": [2, {"z": 1, "a": 2}]}, "a": "x"}') == '{"a":"x","b":{"c":[2,{"a":2,"z":1}],"d":1}}' and key("no json") == "no json"
    assert [one(scalars.chunk_suffix(F.lit(n))) for n in (0, 1, 25, 26, 675)] == ["aa", "ab", "az", "ba", "zz"]
    with pytest.raises(ValueError):
        logs.between(spark.range(1), since="2026-01-01", period="daily")


def test_percentiles_of_a_group_with_very_many_values(spark):
    rows = spark.range(50_000).select((F.col("id") % 2).alias("g"), ((F.col("id") * 7919) % 50_021 / 7.0).alias("v"))
    got = {r["g"]: r for r in stats.describe(rows, "v", ["g"]).collect()}
    for g in (0, 1):
        values = sorted((i * 7919) % 50_021 / 7.0 for i in range(50_000) if i % 2 == g)
        assert [got[g][f"p{p}"] for p in (25, 50, 99)] == [values[min(len(values) * p // 100, len(values) - 1)] for p in (25, 50, 99)]


def test_insert_or_ignore_and_counts_files(spark, tmp_path):
    old = spark.createDataFrame([("a", 1)], "k string, v long")
    new = spark.createDataFrame([("a", 9), ("b", 5), ("b", 3)], "k string, v long")
    assert sorted(tuple(r) for r in ingest.added(old, new.withColumn("o", F.col("v")).select("k", "v"), ["k"], "v").collect()) == [("a", 1), ("b", 3)]
    (tmp_path / "a-counts.csv").write_text('notation,count\n"11H(A, B)",5\n"x""y", 2\nshort\nz,0\nz,-1\n')
    assert sorted((r["notation"], r["count"]) for r in ingest.collection_counts(spark, str(tmp_path)).collect()) == [("11H(A, B)", 5), ('x"y', 2)]
