"""Many queries in one scan: the rows of the single ones, with clusters that are left out."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from arbolex.operators import vector
from arbolex.plans import indexed


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    rng = np.random.default_rng(3)
    middles = rng.normal(size=(12, 16))
    x = vector._units(middles[rng.integers(0, 12, 4000)] + 0.25 * rng.normal(size=(4000, 16)))
    rows = [(f"k{i:04d}", [int(v) for v in np.trunc(r * 127)]) for i, r in enumerate(x)]
    rows += [(f"z{i}", rows[5][1]) for i in range(30)] + [("nothing", [0] * 16), ("null", None)]
    path = str(tmp_path_factory.mktemp("v") / "v")
    plain = spark.createDataFrame(rows, "key string, embedding array<tinyint>")
    at = vector.centres(plain, 24)
    vector.clustered(plain, at).repartitionByRange(3, "cluster").sortWithinPartitions("cluster").write.parquet(path)
    got = spark.read.parquet(path)
    return plain, got, vector.cluster_table(got, at), rows


def _sorted(df):
    return sorted((r["key"], round(r["distance"], 12)) for r in df.collect())


def test_equal_to_single_searches(spark, stored):
    plain, got, clusters, rows = stored
    queries = {f"q{i}": rows[i * 7][1] for i in range(40)} | {"ties": rows[5][1]}
    keep = plain.where("key < 'k2'").select("key")
    for k, how in ((1, {}), (10, {}), (25, {"scope": F.col("key").startswith("k3")}), (5, {"keep": keep})):
        for where, c in ((plain, None), (got, clusters)):
            many = vector.nearest_many(where, "key", queries, k, c, **how)
            by = {q: sorted((r["key"], round(r["distance"], 12)) for r in rs) for q, rs in _groups(many).items()}
            for name in ("q0", "q13", "ties"):
                assert by[name] == _sorted(vector.nearest(plain, "key", queries[name], k, **how)), (k, name)
            assert all(len(v) == k for v in by.values())


def _groups(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["query"], []).append(r)
    return out


def test_a_thousand_queries_and_few_clusters(spark, stored):
    plain, got, clusters, rows = stored
    many = vector.nearest_many(got, "key", {f"q{i}": rows[i][1] for i in range(1000)}, 3, clusters)
    assert many.count() == 3000
    ids, asked = vector.clusters_asked(got, "key", ["q"], np.array([rows[11][1]], float), 3, clusters)
    read = got.where(F.col("cluster").isin([int(c) for c in ids[asked[0]]])).count()
    assert 0 < read < 0.5 * got.count()


def test_no_queries_no_vectors(spark, stored):
    plain, got, clusters, rows = stored
    assert vector.nearest_many(got, "key", {}, 3, clusters).count() == 0
    assert vector.nearest_many(got, "key", {"q": rows[0][1]}, 0).count() == 0
    assert vector.nearest_many(plain.limit(0), "key", {"q": rows[0][1]}, 3).count() == 0
    assert vector.centres(plain.limit(0)).size == 0
    with pytest.raises(Exception, match="dimensions"):
        vector.nearest_many(plain, "key", {"q": [1, 2]}, 3).collect()


def _by_query(df):
    return {q: sorted((str(r["distance"] == r["distance"] and round(r["distance"], 12)), r["key"]) for r in rs) for q, rs in _groups(df).items()}


@pytest.mark.parametrize("slab, k", [(vector.LEAST_SLAB, 5), (50, 3), (50, 80)])
def test_a_table_of_queries(spark, stored, monkeypatch, slab, k):
    plain, got, clusters, rows = stored
    monkeypatch.setattr(vector, "LEAST_SLAB", slab)
    monkeypatch.setattr(vector, "SLAB", slab)
    queries = {f"q{i}": rows[i * 11][1] for i in range(120)} | {"ties": rows[5][1], "zero": [0] * 16}
    table = spark.createDataFrame([*queries.items(), ("null", None)], "query string, embedding array<tinyint>")
    many = _by_query(vector.nearest_each(got, "key", table, k, clusters))
    assert many == _by_query(vector.nearest_many(got, "key", queries, k))
    assert many["q3"] == sorted((str(round(d, 12)), key) for key, d in _pairs(vector.nearest(plain, "key", queries["q3"], k)))


def _pairs(df):
    return [(r["key"], r["distance"]) for r in df.collect()]


def test_a_table_of_queries_on_odd_tables(spark, stored):
    plain, got, clusters, rows = stored
    none = spark.createDataFrame([], "query string, embedding array<tinyint>")
    one = spark.createDataFrame([("q", rows[0][1])], none.schema)
    assert vector.nearest_each(got, "key", none, 3, clusters).count() == 0
    assert vector.nearest_each(got, "key", one, 0, clusters).count() == 0
    assert vector.nearest_each(got.limit(0), "key", one, 3, clusters.limit(0)).count() == 0
    few = got.where("key in ('k0000', 'nothing', 'k0007')")
    at = clusters.select("cluster", "centre").join(few.groupBy("cluster").agg(F.max("angle").alias("radius"), F.count("*").alias("n")), "cluster")
    found = vector.nearest_each(few, "key", one, 5, at).collect()
    assert {r["key"] for r in found} == {"k0000", "nothing", "k0007"}
    with pytest.raises(Exception, match="dimensions"):
        vector.nearest_each(got, "key", spark.createDataFrame([("q", [1, 2])], none.schema), 3, clusters).collect()


def test_knn_many_keeps_its_queries_off_the_driver(spark, tmp_path, monkeypatch):
    """Before, the queries were collected, and the driver held a matrix of queries and clusters."""
    rng = np.random.default_rng(4)
    rows = [(i, [float(v) for v in x], 0) for i, x in enumerate(rng.normal(size=(3000, 8)))]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    monkeypatch.setattr(type(spark.range(1)), "collect", lambda df: pytest.fail("rows are collected"))
    assert indexed.knn_many(spark, str(tmp_path)).count() == 150 * 5


def test_centres_and_clusters_go_in_blocks(spark, stored, monkeypatch):
    plain, got, clusters, rows = stored
    x = vector._units(np.array([r[1] for r in rows[:300]], float))
    near = x @ x[:40].T
    monkeypatch.setattr(vector, "BLOCK", 7)
    own, cosine = vector._nearest_centre(x, x[:40])
    assert (own == near.argmax(axis=1)).all() and np.allclose(cosine, near.max(axis=1))
