"""Nulls in any column, repeated rows, names that clash with the operators' own, and very long texts."""

import random
import time

import pytest
from pyspark.sql import types as T

from arbolex.llm import automata, decontamination, induced, langid, packing, pii, quality, sharding, simhash

from .fixtures import prose

NAMES = ["fp", "component_id", "bit", "_t", "_spans", "_base", "_row", "__first", "__key", "grp", "hits", "range_id", "letters", "n_words", "item_id", "id", "key"]
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), *(T.StructField(n, T.StringType()) for n in NAMES)])


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    t = prose(rng, 60)
    same = (3, t + " x@y.org", "en", "s", 5, *["z"] * len(NAMES))
    return [
        (1, t, "en", "s", 5, *["z"] * len(NAMES)),
        (None, t, None, None, None, *[None] * len(NAMES)),
        (None, None, None, None, None, *[None] * len(NAMES)),
        same,
        same,
        (4, None, "en", None, 0, *[None] * len(NAMES)),
        (5, "x" * 300_000, "en", "s", 1, *[None] * len(NAMES)),
        (6, "a1 " * 60_000, None, "s", 1, *["z"] * len(NAMES)),
        (7, prose(rng, 60_000), "de", "s", 1, *["z"] * len(NAMES)),
        (8, " " * 200_000 + "é", "de", "s", 1, *["z"] * len(NAMES)),
        (9, "1 2-3 " * 30_000 + "@" * 1000 + "+1 " * 3000, "de", "s", 1, *["z"] * len(NAMES)),
    ]


OPERATORS = {
    "decontamination": lambda d, b: decontamination.with_hits(d, b),
    "words": lambda d, b: automata.passage_dedup(d),
    "bytes": lambda d, b: induced.byte_dedup(d),
    "simhash": lambda d, b: simhash.grouped(d),
    "pii": lambda d, b: pii.with_spans(d.select("doc_id", "text")),
    "sharding": lambda d, b: sharding.shard(d),
    "langid": lambda d, b: langid.identify(d),
    "quality": lambda d, b: quality.judged(d),
}
STAGES = {
    "langid": (lambda d, b: langid.determined(d), None),
    "simhash": (lambda d, b: simhash.deduplicated(d), None),
    "decontamination": (lambda d, b: decontamination.decontaminated(d, b), 11),
    "pii": (lambda d, b: pii.redacted(d), 11),
}


@pytest.fixture(scope="module")
def tables(spark, rows):
    bench = spark.createDataFrame([(None, None), (1, None), (None, "a b c d e f g h i j"), (2, "one two three four five six seven eight nine ten")], "item_id long, text string")
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache(), bench


@pytest.mark.parametrize("name", OPERATORS)
def test_every_row_has_its_result(tables, rows, name):
    began = time.time()
    got = OPERATORS[name](*tables).collect()
    # fingerprints of rows without an id still come back, once a row
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got) == sorted((r[0] is None, r[0] or 0) for r in rows)
    assert time.time() - began < 60


@pytest.mark.parametrize("name", STAGES)
def test_stages_keep_clashing_columns(tables, name):
    docs, bench = tables
    f, n = STAGES[name]
    got = f(docs, bench)
    assert got.schema.simpleString() == docs.schema.simpleString()
    out = got.collect()
    assert n is None or len(out) == n
    assert all(r["fp"] in ("z", None) and r["_t"] in ("z", None) and r["_row"] in ("z", None) for r in out)


def test_packing_takes_all(tables, rows):
    got = packing.pack(tables[0]).collect()
    assert {r["doc_id"] for r in got} == {r[0] for r in rows}
    assert sum(r["length"] for r in got) == sum(len(packing.token_ids(r[1] or "")) + 1 for r in rows)
