"""Postings in blocks: pages equal those of a full scan, buckets meet without a shuffle, broad queries read few blocks."""

import random

import pytest
from pyspark.sql import functions as F

from arbolex.operators import ranked, text
from arbolex.sources import store


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("ranked") / "i'x")
    rng = random.Random(7)
    words = [f"w{k}" for k in range(300)]
    weights = [1 / (k + 1) for k in range(300)]
    rows = [(f"{i:05d}", " ".join(rng.choices(words, weights, k=rng.choice((1, 2, 3, 5, 8, 20, 60))))) for i in range(6000)]
    rows += [("empty", ""), ("null", None), ("twice", "w0 w1"), ("twice", "w0 w1")]
    table = text.token_table(spark.createDataFrame(rows, "notation string, t string"), "t", "notation")
    table.repartition(3).write.parquet(path)
    table = spark.read.parquet(path)
    store.write_postings(table, path)
    return table, store.read_postings(spark, path)


ASKED = ([["w0"]], [["w1"], ["w0"]], [["w0", "w1"]], [["w0", "w0"]], [["w2"], ["w0", "w1"]], [["w250"]], [["w1"], ["w7"], ["w0"]])


def _rows(df):
    return sorted((r["notation"], round(r["rank"], 9)) for r in df.collect())


@pytest.mark.parametrize("asked", ASKED, ids=str)
def test_same_hits_and_pages_as_a_scan(indexed, asked):
    table, p = indexed
    for scope in (None, F.col("notation").startswith("01")):
        whole = text.search(table, asked, scope)
        assert _rows(ranked.search_postings(p, asked, scope)) == _rows(whole)
        for k in (1, 10, 10_000):
            want = [(r["notation"], round(r["rank"], 9)) for r in whole.orderBy("rank", "notation").limit(k).collect()]
            got = [(r["notation"], round(r["rank"], 9)) for r in ranked.page(p, asked, k, scope, first_blocks=2).rows.collect()]
            assert [r for _, r in got] == [r for _, r in want]
            assert sorted(got[:-1]) == sorted(want[:-1]) or k > 1


def test_unknown_words_and_no_words(indexed):
    _, p = indexed
    for asked in ([["nowhere"]], [["w0"], ["nowhere"]], []):
        assert ranked.search_postings(p, asked).count() == 0
        assert ranked.page(p, asked, 5).rows.count() == 0


def test_a_broad_page_reads_a_small_share(spark, tmp_path):
    rng = random.Random(3)
    rows = [(f"{i:05d}", " ".join(["w0", *(f"x{rng.randrange(999)}" for _ in range(rng.randrange(1, 80)))])) for i in range(20_000)]
    path = str(tmp_path / "broad")
    text.token_table(spark.createDataFrame(rows, "notation string, t string"), "t", "notation").write.parquet(path)
    store.write_postings(spark.read.parquet(path), path)
    p = store.read_postings(spark, path)
    page = ranked.page(p, [["w0"]], 25, first_blocks=2)
    assert page.there == 20_000 and page.read <= 3000
    want = text.search(spark.read.parquet(path), [["w0"]]).orderBy("rank", "notation").limit(25).collect()
    assert [r["notation"] for r in page.rows.collect()] == [r["notation"] for r in want]


def test_buckets_meet_without_a_shuffle(indexed):
    _, p = indexed
    found = ranked._all_places(p, [["w1", "w0"], ["w2"]], p.frequencies(["w0", "w1", "w2"]), None)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Bucketed: true" in plan and "ShuffledHashJoin" in plan, plan
    assert "EqualTo(token,w1)" in plan


def test_blocks_and_postings_are_those_of_the_texts_without_moving_postings(indexed):
    table, p = indexed
    texts, avg = ranked.numbered(table), p.statistics.first()["_avg"]
    want = {}
    for r in texts.collect():
        words = r["padded"].split()
        for w in set(words):
            df, best = want.get((w, r["block"]), (0, 0.0))
            want[w, r["block"]] = df + 1, max(best, ranked.impact(float(words.count(w)), r["n_tokens"], avg))
    made = ranked.block_table(texts, p.statistics, 3)
    for got in (made, p.blocks):
        rows = got.collect()
        assert {(r["token"], r["block"]): (r["df"], round(r["best"], 12)) for r in rows} == {k: (n, round(x, 12)) for k, (n, x) in want.items()}
        assert len(rows) == len(want)
    postings = ranked.index(texts.repartition(5, "doc"))
    for df in (made, postings):
        assert df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1].count("Exchange hash") == 1
    places = {(r["token"], r["doc"]): list(r["positions"]) for r in postings.collect()}
    assert places == {(w, r["doc"]): [i for i, x in enumerate(r["padded"].split()) if x == w] for r in texts.collect() for w in r["padded"].split()}
