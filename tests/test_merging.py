"""Tables changed by key: reads between changes, compaction of touched ranges, bytes in proportion, sums that stay right."""

import os
import random

import pytest

from arbolex.operators import overlay
from arbolex.operators.engine import Engine
from arbolex.sources import merging, store

from . import vocab

KEY = ["k", "g"]


def _size(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(path) for f in fs)


def test_reads_are_those_of_a_dict(spark, tmp_path):
    rng, path, now = random.Random(5), str(tmp_path / "t"), {}
    frame = lambda rows: spark.createDataFrame([(*k, v) for k, v in rows.items()], "k string, g long, v long")
    rows = {(f"{i:04d}" if i > 99 else "", i): i for i in range(3000)} | {(None, 1): -1}
    now |= rows
    merging.merge(spark, path, frame(rows), KEY)  # creates it
    check = lambda: {(r["k"], r["g"]): r["v"] for r in merging.read(spark, path, KEY).collect()}
    assert check() == now
    before, held = _size(f"{path}/parts"), merging.read(spark, path, KEY)
    for step in range(4):
        rows = {(f"{rng.randrange(40):04d}", rng.randrange(4)): 10_000 * step + i for i in range(9)} | ({(None, 1): step, (None, None): step} if step == 2 else {})
        now |= rows
        merging.merge(spark, path, frame(rows), KEY)
        assert check() == now
    assert _size(f"{path}/parts") - before < before, "a change writes its own rows"
    assert held.count() == 3001, "a reader of an older head is not disturbed"
    whole = {b[1]: b[0] for b in merging.head(spark, path).base}
    touched = merging.compact(spark, path, KEY)
    h = merging.head(spark, path)
    assert check() == now and h.deltas == [] and 0 < len(touched) < 5
    assert {i for i, p in ((b[1], b[0]) for b in h.base) if p != whole[i]} == set(touched)
    assert merging.compact(spark, path, KEY) == []
    merging.merge(spark, path, frame({("9999", 7): 1}), KEY)
    merging.cleaned(spark, path)
    assert check() == now | {("9999", 7): 1}
    merging.merge(spark, path, frame({}), KEY)
    assert len(check()) == len(now) + 1
    with pytest.raises(FileNotFoundError):
        merging.read(spark, str(tmp_path / "none"), KEY)


def test_a_change_that_is_cut_off_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    merging.create(spark.createDataFrame([("a", 1, 1)], "k string, g long, v long"), path, KEY)
    spark.range(1).write.json(f"{path}/heads/7")
    os.remove(f"{path}/heads/7/_SUCCESS")
    merging._part(spark.createDataFrame([("a", 1, 2)], "k string, g long, v long"), path)
    assert [r["v"] for r in merging.read(spark, path, KEY).collect()] == [1]


def test_sums_stay_right_over_many_upserts(spark, tmp_path):
    rng, path = random.Random(2), str(tmp_path / "s")
    store.write(vocab.vocabulary(spark), path)
    counts = {(c, n): k for c, n, k in vocab.rows()[3]}
    codes = [r["notation"] for r in store.open_store(spark, path).notations.collect()][:12] + ["UNKNOWN", "nobody"]
    for step in range(12):
        rows = {(rng.choice(["a-cat", "b_cat", "c", "new"]), rng.choice(codes)): rng.randrange(50) for _ in range(4)}
        counts |= rows
        new = spark.createDataFrame([(*k, v) for k, v in rows.items()], store.SCHEMAS["counts"])
        store.upsert_counts(spark, path, new)
        if step == 3:
            store.upsert_counts(spark, path, new)  # again: nothing changes
        if step == 7:
            store.compact_counts(spark, path)
    v = store.open_store(spark, path)
    assert {(r["collection_id"], r["notation"]): r["count"] for r in v.counts.collect()} == counts
    rows = lambda df: sorted(map(repr, df.select("kind", "name", "coverage", "collections", "known").collect()))
    assert rows(v.sums) == rows(overlay.sums(v.counts, v.notations))
    totals = {r["collection_id"]: r["known_notations"] for r in overlay.kept_totals(v.info, v.sums).collect()}
    assert totals == {r["collection_id"]: r["known_notations"] for r in overlay.collection_totals(v.info, v.counts, v.notations).collect()}


def test_a_search_does_not_sum_the_overlay(spark, tmp_path):
    path = str(tmp_path / "s")
    store.write(vocab.vocabulary(spark), path)
    v = store.open_store(spark, path)
    plan = overlay.kept_coverage(v.notations.select("notation"), v.sums)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "collection_id" not in plan
    e = Engine(v)
    assert e.search(query="angel with trumpet")["total"] == 2 and e.search(query="trumpet angel")["total"] == 2
    assert e.search(query="nothing such")["total"] == 0 and e.search(query="beasts", collection="a-cat")["total"] == 1
