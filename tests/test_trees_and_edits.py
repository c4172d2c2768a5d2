"""Intervals of trees against a walk, near codes against their definition, percentiles against sorted lists."""

import math
import random

from pyspark.sql import functions as F

from arbolex.functions import stats
from arbolex.operators import hierarchy

from . import vocab


def test_intervals_are_those_of_a_walk(spark):
    v = vocab.vocabulary(spark)
    nodes = {r["notation"]: r for r in v.notations.collect()}
    parent = {n: next((p for p in reversed(r["path"]) if p in nodes and p != n), None) for n, r in nodes.items()}
    kids = {}
    for n, p in parent.items():
        kids.setdefault(p, []).append(n)
    want, count = {}, 0

    def walk(n, depth):
        nonlocal count
        at, count = count, count + 1
        listed = nodes[n]["children"]
        for c in sorted(kids.get(n, []), key=lambda c: (listed.index(c) if c in listed else math.inf, c)):
            walk(c, depth + 1)
        want[n] = (parent[n], depth, at, count - at)

    for root in sorted(kids[None]):
        walk(root, 0)
    tree = hierarchy.intervals(v.notations)
    got = {r["notation"]: (r["parent"], r["depth"], r["pre"], r["size"]) for r in tree.collect()}
    assert got == want
    _, _, pre, size = got["73D"]
    assert [r["notation"] for r in hierarchy.below(tree, pre, size).collect()] == ["73D", *(f"73D{i}" for i in (1, 2, 3, 5, 6, 7, 8, 9))]
    assert hierarchy.intervals(v.notations.limit(0)).count() == 0
    asked = spark.createDataFrame([("x", ["7", "73", "73Q", "73QX"]), ("y", ["no"]), ("z", [])], "code string, path array<string>")
    assert {r["code"]: r["ancestor"] for r in hierarchy.deepest_known(asked, tree).collect()} == {"x": "73", "y": None, "z": None}


def test_near_codes_by_deletions(spark):
    rng = random.Random(6)
    known = {"".join(rng.choice("0123ABxé(") for _ in range(rng.randrange(0, 6))) for _ in range(700)} | {"a", "", "11", "111", "1111"}
    asked = list(known)[:200] + ["11", "zz", "", "Q1"]
    frame = lambda rows, name: spark.createDataFrame([(r,) for r in rows], f"{name} string")
    codes, names = frame([*asked, None], "code"), frame([*known, None], "notation")
    wide = hierarchy.near_codes(frame(asked, "code")).join(frame(known, "candidate"), "candidate", "left_semi")
    rows = lambda df: sorted(tuple(r[c] for c in ("code", "kind", "kind_ord", "pos", "change", "candidate")) for r in df.collect())
    index = hierarchy.edit_index(names)
    assert rows(hierarchy.near_known(codes, index)) == rows(wide)
    few = index.count() + sum(len(c) + 1 for c in set(asked))
    assert few * 3 < hierarchy.near_codes(frame(asked, "code")).count() + len(known), "in all, with the index made anew"


def test_percentiles_of_any_numbers(spark):
    rng = random.Random(9)
    sets = {
        "narrow": [1.7e15 + rng.random() * 1e-3 for _ in range(500)] + [1.7e15 + i for i in range(500)],
        "wide": [rng.choice([-1, 1]) * math.exp(rng.uniform(-300, 300)) for _ in range(999)],
        "ties": [5.0] * 700 + [0.0, -0.5, 7.25],
        "odd": [math.inf, -math.inf, 0.0, 1.0, 5e-324, -5e-324, 1.7e308, math.nan],
        "one": [3.5],
    }
    rows = [(g, v) for g, vs in sets.items() for v in [*vs, None]] + [(None, 4.0)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(7)
    percents = (0, 1, 25, 50, 75, 90, 99, 100)
    got = {r["g"]: r for r in stats.percentiles(df, "v", ["g"], percents).collect()}
    assert set(got) == {*sets, None}
    for g, vs in sets.items():
        order = sorted(vs, key=lambda x: (math.isnan(x), x))
        want = [order[min(len(order) * p // 100, len(order) - 1)] for p in percents]
        assert [repr(got[g][f"p{p}"]) for p in percents] == [repr(x) for x in want], g
        assert got[g]["n"] == len(vs) and repr(got[g]["max"]) == repr(order[-1]) and got[g]["min"] == order[0]
    whole = df.selectExpr("g", "cast(v as int) as v").where("g = 'ties'")
    assert stats.describe(whole, "v", ["g"], (50,)).first().asDict() == {"g": "ties", "n": 703, "min": 0, "p50": 5, "max": 7, "mean": round((3500 + 7) / 703, 2)}
    assert stats.describe(df.where(F.lit(False)), "v", ["g"]).count() == 0


def test_known_codes_are_not_broadcast(spark, tmp_path):
    """A small file may hold very many codes, and their edits are several times as many."""
    spark.range(1000).selectExpr("concat('P', id) AS notation").write.parquet(f"{tmp_path}/known")
    known = spark.read.parquet(f"{tmp_path}/known")
    asked = known.where("notation in ('P7', 'P120')").withColumnRenamed("notation", "code")
    got = hierarchy.first_near(hierarchy.near_known(asked, hierarchy.edit_index(known)), known, 10)
    assert "BroadcastExchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert got.where("code = 'P7'").count() == 10
