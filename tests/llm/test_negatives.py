"""Hard negatives against brute force, pruning, exact sums, and defined cases."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from arbolex.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int, id string, q string, key string, shard string"


def brute(rows, anchor=lambda i: i % 50 == 0):
    some = {}
    for vec_id, v, label in rows:
        if vec_id is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        label = (label + 1) % 10 if vec_id % 7 == 0 else label
        some[(vec_id, label, tuple(math.floor(256 * x) for x in v))] = None
    score = lambda a, b: sum(x * y for x, y in zip(a[2], b[2]))
    out = set()
    for a in some:
        if not anchor(a[0]):
            continue
        order = sorted(some, key=lambda b: (-score(a, b), b[0]))
        for p in [b for b in order if b[1] == a[1] and b is not a][:5]:
            s = score(a, p)
            fits = [b for b in order if b[1] != a[1] and 50 * s <= 100 * score(a, b) <= 95 * s][:3]
            out |= {(a[0], p[0], k, b[0], s, score(a, b)) for k, b in enumerate(fits, 1)}
    return out


def as_rows(df):
    got = [(r["anchor_id"], r["positive_id"], r["rank"], r["negative_id"], r["positive_score"], r["negative_score"]) for r in df.collect()]
    assert len(got) == len(set(got))
    return set(got)


def unit(rng, dim, middle=None, spread=1.0):
    v = np.array([rng.gauss(0, 1) for _ in range(dim)]) * spread + (0 if middle is None else middle)
    return [float(x) for x in np.float32(v / max(np.linalg.norm(v), 1e-9))]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(12)
    middles = [np.array(unit(rng, 8)) for _ in range(6)]
    out = [(i, unit(rng, 8, rng.choice(middles), 0.2), rng.choice((0, 0, 0, 1, 2, 9))) for i in range(600)]
    out[100] = (100, None, 1)
    out[150] = (150, [1.0, None, *[0.0] * 6], 1)
    out[200] = (200, [math.nan] + [0.0] * 7, 1)
    out[201] = (201, [math.inf] + [0.0] * 7, 1)
    out[250] = (250, out[250][1], None)
    out += [(None, out[3][1], 1), (700, [0.5], 0), (750, [], 0), (800, [0.0] * 8, 2)] + [(1000 + i, out[0][1], out[0][2]) for i in range(40)] + [(2000 + i, out[0][1], 5) for i in range(40)]
    return out


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", None, "y", "z") for r in rows], SCHEMA)


def mined(df, **how):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(negatives.integers(df.withColumn("label", label)), F.col("id") % 50 == 0, **how)


@pytest.mark.parametrize("how", [{}, {"shard_rows": 100, "anchor_block": 3, "leaf": 8}, {"leaf": 1}], ids=str)
def test_against_all_pairs(spark, rows, how):
    assert as_rows(mined(table(spark, rows).repartition(5), **how)) == brute(rows)


def test_repeated_rows_count_once(spark, rows):
    assert as_rows(mined(table(spark, [*rows, *rows[:200]]).repartition(3))) == brute(rows)


def test_empty_tables(spark, rows):
    assert mined(table(spark, rows).limit(0)).count() == 0
    assert mined(table(spark, rows[1:40])).count() == 0, "no anchors"


def test_branches_are_left_out():
    rng = np.random.default_rng(1)
    middles = rng.normal(size=(30, 16)) * 4
    x = np.floor((middles[rng.integers(0, 30, 6000)] + 0.1 * rng.normal(size=(6000, 16))) * 256).astype(np.int64)
    ids, labels = np.arange(6000), rng.integers(0, 3, 6000)
    found = negatives.Search(x, labels, ids, ids, 5, True)
    q = np.arange(60)
    score, place = found.run(x[:60], labels[:60], ids[:60], ids[:60], q, np.full(60, negatives._LEAST), np.full(60, negatives._MOST))
    assert found.visited < 0.2 * 60 * 6000
    for a in range(0, 60, 7):
        s = x @ x[a]
        want = sorted((b for b in range(6000) if b != a and labels[b] == labels[a]), key=lambda b: (-s[b], b))[:5]
        assert found.ids[place[a]].tolist() == want and score[a].tolist() == s[want].tolist()
    narrow = negatives.Search(x, labels, ids, ids, 3, False)
    narrow.run(x[:60], labels[:60], ids[:60], ids[:60], q, np.full(60, 10**6), np.full(60, 10**6 + 5000))
    assert narrow.visited < 0.7 * 60 * 6000


def test_products_are_exact():
    a = np.array([[3_000_000_019, -7], [1, 2]], np.int64)
    b = np.array([[1_000_000_007, 5], [0, 0], [-4, 1]], np.int64)
    want = [[sum(int(x) * int(y) for x, y in zip(r, c)) for c in b] for r in a]
    assert negatives.products(a, b).tolist() == want
    with pytest.raises(OverflowError):
        negatives.products(np.array([[1 << 40]]), np.array([[1 << 40]]))


def test_query(spark, tmp_path, rows):
    table(spark, rows).drop("id", "q", "key", "shard").coalesce(2).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert as_rows(negatives.op13_ball_tree_negatives(spark, str(tmp_path))) == brute(rows)
