"""Cases that once went wrong: large ids beside nulls, repeated ids, long secrets, schemas, open tags, repetitive texts."""

import random
import time

from pyspark.sql import functions as F

from arbolex.llm import chat, common, decontamination, packing, pii, sharding, similar, simhash

from .fixtures import prose


def test_packing_keeps_large_ids_beside_nulls(spark):
    rows = [(2**53 + 1, "hello"), (None, "b"), (2**53 + 3, "x y"), (None, "b"), (2**62 + 1, None)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0) for r in got) == sorted((d or 0) for d, _ in rows)


def test_unlike_texts_of_one_id_both_stay(spark):
    rng = random.Random(1)
    t, other, third = prose(rng, 200), prose(rng, 200), prose(rng, 200)
    rows = [(3, t), (5, t), (5, other), (5, other), (6, other + " more"), (7, third), (None, t), (8, None), (8, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for grouper in (None, similar.grouped):
        got = sorted(((r["doc_id"], r["text"]) for r in simhash.deduplicated(docs, grouper=grouper).collect()), key=repr)
        kept = {(3, t), (5, other), (7, third), (None, t)} | ({(6, other + " more")} if grouper is None else set())
        assert {(d, x) for d, x in got if x} >= kept - {(6, other + " more")} and (5, t) not in got
        assert sum(x == other for _, x in got) == 1


def test_whole_secrets_go(spark):
    for n in (6, 199, 200, 201, 360, 5000):
        value = "aB3" * n
        got = pii.redacted(spark.createDataFrame([(1, f"set token={value[:n]} now")], "doc_id long, text string")).first()["text"]
        assert got == "set <SECRET> now", n
    spelled = "write to jane.doe [at] mail [dot] office [dot] north [dot] example [dot] co [dot] uk please"
    assert "dot" not in pii.redacted(spark.createDataFrame([(1, spelled)], "doc_id long, text string")).first()["text"]
    assert pii.redacted(spark.createDataFrame([(1, "a [at] b" + " [dot] c" * 50_000)], "doc_id long, text string")).count() == 1


RULES = [
    ({"exclusiveMinimum": 3}, 3.5, 3), ({"exclusiveMaximum": 3}, 2, 3), ({"multipleOf": 0.1}, 0.3, 0.35), ({"const": [1, {"a": 2}]}, [1.0, {"a": 2}], [1, {"a": True}]),
    ({"enum": [1, "x"]}, 1.0, True), ({"enum": [False]}, False, 0), ({"minItems": 2}, [1, 2], [1]), ({"maxItems": 1}, [], [1, 2]), ({"uniqueItems": True}, [1, True, "1"], [1, 1.0]),
    ({"anyOf": [{"type": "string"}, {"minimum": 5}]}, "a", 4), ({"oneOf": [{"type": "integer"}, {"minimum": 5}]}, 4, 6), ({"allOf": [{"minimum": 1}, {"maximum": 2}]}, 2, 3), ({"not": {"type": "null"}}, 1, None),
    ({"$defs": {"p": {"type": "integer"}}, "properties": {"a": {"$ref": "#/$defs/p"}}}, {"a": 1}, {"a": "1"}), ({"additionalProperties": {"type": "number"}, "properties": {"a": {}}}, {"a": "x", "b": 1}, {"b": "x"}),
    ({"patternProperties": {"^x": {"type": "string"}}, "additionalProperties": False}, {"xa": ""}, {"a": ""}), ({"minProperties": 1}, {"a": 1}, {}), ({"maxProperties": 0}, {}, {"a": 1}), ({"propertyNames": {"maxLength": 1}}, {"a": 1}, {"ab": 1}),
    ({"dependentRequired": {"a": ["b"]}}, {"b": 1}, {"a": 1}), ({"prefixItems": [{"type": "string"}], "items": {"type": "integer"}}, ["a", 1], ["a", "b"]), ({"items": [{"type": "string"}]}, ["a", 1], [1]),
    ({"contains": {"const": 1}}, [0, 1], [0]), ({"if": {"type": "string"}, "then": {"minLength": 2}, "else": {"minimum": 2}}, "ab", 1), ({"type": ["null", "boolean"]}, None, 0), (False, None, 1), ({"items": False}, [], [1]),
]


def test_schemas_are_checked_in_full():
    for schema, good, bad in RULES:
        if schema is not False:
            assert chat.schema_error(good, schema) is None, schema
        assert chat.schema_error(bad, schema), schema
    for schema in ({"unevaluatedProperties": False}, {"type": "date"}, {"$ref": "http://x"}, {"$ref": "#"}, {"properties": {"a": {"dependentSchemas": {}}}}):
        assert chat.schema_error({"a": "b"} if "properties" in str(schema) else "b", schema).startswith("unsupported schema"), schema
    for schema in ({"pattern": "("}, {"minLength": "x"}, {"enum": 3}, 7):
        assert chat.schema_error("b", schema) == "bad schema", schema
    assert chat.schema_error(1, {"title": "t", "description": "d", "default": 1, "format": "x"}) is None


def test_many_open_tags_take_one_pass():
    began = time.perf_counter()
    assert chat.blocks("<tool_call>" * 100_000) == []
    assert len(chat.blocks("<tools>" * 50_000 + "<tool_call>{}</tool_call>" * 10_000)) == 10_000
    assert time.perf_counter() - began < 5
    text = "a<tool_call>1<tool_call>2</tool_call>b</tool_call><tools>x</tool_call></tools><tool_result>"
    assert [(k, c) for k, c, _, _ in chat.blocks(text)] == [("tool_call", "1<tool_call>2"), ("tools", "x</tool_call>")]


def test_a_text_that_repeats_an_item_takes_time_in_proportion(spark):
    item = "one two three four five six seven eight nine ten eleven twelve"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    seconds = []
    for n in (500, 8000):
        docs = spark.createDataFrame([(1, (item + " ") * n), (2, "nothing of it")], "doc_id long, text string")
        began = time.perf_counter()
        got = {r["doc_id"]: r for r in decontamination.with_hits(docs, bench).collect()}
        seconds.append(time.perf_counter() - began)
        assert got[1] != got[2]
    assert seconds[1] < 10


def test_shards_of_rows_without_ids(spark):
    rows = spark.range(30_000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("t"), F.col("id") % 3).alias("text"))
    got = sharding.shard(rows, 10)
    sizes = [r["s"] for r in got.groupBy("shard").agg(F.sum("size").alias("s")).collect()]
    assert len(sizes) == 10 and max(sizes) - min(sizes) <= 0.02 * sum(sizes)
    assert got.groupBy("range_id").count().agg(F.max("count")).first()[0] < 5000
    places = got.groupBy("shard").agg(F.max("slot").alias("m"), F.count_distinct("slot").alias("n")).collect()
    assert all(r["m"] + 1 == r["n"] for r in places)
    assert common.parts(spark) > 0
