"""As-of joins against their definition, with ties, nulls, hot keys and repeated rows."""

import random
import time
from datetime import datetime, timedelta

from arbolex.operators.asof import next_after


def _brute(starts, others):
    return sorted(((k, t, i, min((o for j, o in others if j == k and o is not None and t is not None and o > t), default=None)) for k, t, i in starts), key=repr)


def test_against_the_definition(spark):
    rng, zero = random.Random(4), datetime(2026, 1, 1)
    at = lambda: None if rng.random() < 0.05 else zero + timedelta(seconds=rng.randrange(300))
    key = lambda: rng.choice(["hot", "hot", "hot", "b", None])
    starts = [(key(), at(), i) for i in range(400)] + [("alone", at(), -1), ("hot", None, -2)] + [("hot", zero, -3)] * 3
    others = [(key(), at()) for _ in range(150)] + [("nobody", zero)]
    a = spark.createDataFrame(starts, "k string, ts timestamp, _t long").repartition(5)
    b = spark.createDataFrame(others, "k string, ts timestamp").repartition(3)
    for ranges in (1, 2, 64):
        got = next_after(a, b, ["k"], ranges=ranges)
        assert got.columns == ["k", "ts", "_t", "next_ts"]
        assert sorted((tuple(r) for r in got.collect()), key=repr) == _brute(starts, others)
    assert next_after(a.limit(0), b, ["k"]).count() == 0
    assert {r["next_ts"] for r in next_after(a, b.limit(0), ["k"]).collect()} == {None}


def test_one_key_is_split_and_takes_time_in_proportion(spark):
    def seconds(n):
        both = spark.range(n, numPartitions=4).selectExpr("0 AS k", "timestamp_micros(id * 1000003 % 7919000000) AS ts", "id % 2 AS side")
        began = time.perf_counter()
        got = next_after(both.where("side = 0").select("k", "ts"), both.where("side = 1").select("k", "ts"), ["k"])
        assert got.where("next_ts > ts or next_ts is null").count() == n // 2
        return time.perf_counter() - began

    seconds(2_000)
    few, many = seconds(16_000), seconds(160_000)
    assert many < 10 * few + 5
    rows = spark.range(4000).selectExpr("0 AS k", "timestamp_micros(id) AS ts")
    spread = next_after(rows, rows, ["k"])
    assert "_range" in spread._jdf.queryExecution().optimizedPlan().toString()
    assert spread.where("next_ts is null").count() == 1 and spread.where("unix_micros(next_ts) - unix_micros(ts) = 1").count() == 3999
