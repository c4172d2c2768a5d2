"""Sessions kept by a stream: merging, restarts, late calls, and the same rows as a batch."""

import random

from pyspark.sql import functions as F

from arbolex.operators import logs
from arbolex.streaming import sessions

MINUTE = 60_000_000


def test_sessions_merge_in_any_order():
    rng = random.Random(1)
    calls = [sessions.summary(rng.randrange(5000) * MINUTE, i, rng.choice("ab"), [1, 0], [f"t{rng.randrange(9)}"], rng.randrange(4)) for i in range(300)]
    want = sessions.joined([], calls, 10 * MINUTE)
    open_: list = []
    for lo in range(0, 300, 17):
        open_ = sessions.joined(open_, calls[lo : lo + 17], 10 * MINUTE)
    assert open_ == want and sum(x["c"] for x in want) == 300 and len(want) > 20


def test_a_stream_with_restarts_gives_what_a_batch_gives(spark, tmp_path):
    sessions.with_state_store(spark)
    rng = random.Random(2)
    rows = []
    for i in range(400):
        tool = rng.choice(["search", "browse", "resolve", "find_artworks"])
        inside = {"search": '{"semanticQuery": "s%d"}', "browse": '{"notation": "n%d"}', "resolve": '{"notation": "r%d"}', "find_artworks": '{"notation": "f%d"}'}[tool] % rng.randrange(5)
        rows.append((i, rng.choice(["u", "u", "v", None]), 10**12 + i * 397 * 1_000_000 % (1_000_000 * 100_000) + i, tool, rng.randrange(3000), rng.random() < 0.9, inside))
    schema = "ord long, who string, us long, tool string, ms long, ok boolean, input string"
    by_time = sorted(rows, key=lambda r: r[2])
    calls = lambda df: df.select("ord", "who", F.timestamp_micros("us").alias("ts"), "tool", "ms", "ok", "input")

    def arrive(some, k):
        rng.shuffle(some)  # within a file in any order
        spark.createDataFrame(some, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{k}")

    late = 0
    stream = lambda: calls(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*"))
    for k in range(3):  # three runs over one checkpoint
        arrive(by_time[len(rows) * k // 3 : len(rows) * (k + 1) // 3], k)
        if k == 2:
            arrive([(9999, "u", 0, "browse", 1, True, "{}")], 3)  # far too late
            arrive([(9998, "end", 10**15, "browse", 1, True, "{}")], 4)
            arrive([(9997, "end", 2 * 10**15, "browse", 1, True, "{}")], 5)
        run = sessions.keep_appended(sessions.of_calls(stream(), ["who"], gap=600, late="1 minute"), f"{tmp_path}/out", f"{tmp_path}/state")
        run.awaitTermination()
        late += sessions.dropped(run)
    assert late == 1
    got = {}
    for r in spark.read.parquet(f"{tmp_path}/out").where("who is null or who != 'end'").collect():
        got.setdefault(r["who"], []).append((r["start"], r["end"], r["calls"], r["tools"], r["slow"], r["errors"], r["semantic"], r["topics"], r["class"], r["seconds"]))
    whole = calls(spark.createDataFrame(rows, schema))
    for who in ("u", "v", None):
        want = logs.sessions(whole.where(F.col("who").eqNullSafe(F.lit(who))), gap=600)
        want = [(r["start"], r["end"], r["calls"], r["tools"], r["slow"], r["errors"], r["semantic"], r["topics"], r["class"], r["seconds"]) for r in want.orderBy("session").collect()]
        assert sorted(got[who]) == want, who
