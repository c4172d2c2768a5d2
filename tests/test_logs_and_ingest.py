import gzip
import json
import os

import pytest
from pyspark.sql import functions as F

from arbolex.functions import scalars, stats
from arbolex.operators import hierarchy, logs
from arbolex.plans import indexed, registry, vocabulary  # noqa: F401
from arbolex.sources import ingest, store
from arbolex.streaming import usage

from .compare import connection, differences

LOG = [
    {"timestamp": "2026-01-01T10:00:00.123456789Z", "message": "Starting Container"},
    {"timestamp": "2026-01-01T10:00:08Z", "message": "listening on 3000"},
    {"timestamp": "2026-01-01T10:01:00Z", "tool": "Server:search", "ms": 40, "ok": True, "input": {"query": "horse"}},
    {"timestamp": "2026-01-01T10:02:00Z", "tool": "search", "ms": "12.7", "input": '{"query": "horse"}'},
    {"timestamp": "2026-01-01T11:02:00Z", "tool": "search", "ms": 6000, "ok": True, "input": {"semanticQuery": "grief"}},
    {"timestamp": "2026-01-01T12:02:01Z", "tool": "resolve", "ms": 3, "ok": False, "error": "x", "input": {"notation": ["7", "73", "7"]}},
    {"timestamp": "2026-01-02T12:00:00Z", "tool": "browse", "ms": 3, "ok": True, "input": {"notation": "73D", "depth": 2}},
    {"timestamp": "2026-01-02T12:00:01Z", "message": "Starting Container"},
    {"tool": "browse", "ms": 3},
    {"timestamp": "2026-01-02T12:00:02Z", "message": "something else"},
]


@pytest.fixture(scope="module")
def lines(spark):
    rows = [(i, json.dumps(x)) for i, x in enumerate(LOG)] + [(90, "not json"), (91, ""), (92, "[1]")]
    return spark.createDataFrame(rows, "ord long, value string")


def test_calls(lines):
    got = logs.calls(lines).orderBy("ord").collect()
    assert [(r["tool"], r["ms"], r["ok"]) for r in got] == [("search", 40, True), ("search", 12, True), ("search", 6000, True), ("resolve", 3, False), ("browse", 3, True)]
    assert json.loads(got[1]["input"]) == {"query": "horse"}
    assert logs.startups(lines).count() == 3


def test_sessions(lines):
    got = logs.sessions(logs.calls(lines)).orderBy("session").collect()
    # a gap of exactly 60 minutes goes on; one second more does not
    assert [(r["calls"], r["class"]) for r in got] == [(3, "browsing"), (1, "quick-lookup"), (1, "quick-lookup")]
    assert got[0]["topics"] == ['query: "horse"', 'semantic: "grief"'] and got[0]["duration"] == "1h 1m"


def test_boots_and_repeats(lines):
    got = logs.boots(logs.startups(lines)).orderBy("ts").collect()
    assert [r["seconds"] for r in got] == [pytest.approx(7.876544), None]
    rows = logs.calls(lines).withColumn("key", scalars.canonical_object(F.col("input")))
    r = logs.repeats(rows, ["tool", "key"], "ms", ["ts", "ord"]).collect()
    assert [(x["first"], x["repeat"]) for x in r] == [(40, 12)]
    assert logs.cycling_hours(logs.startups(lines)).first()["starts"] == 2


def test_report(lines):
    got = logs.report(lines)
    for part in ("## Traffic", "| search | 3 | 0 |", "## Boot times", "unused tools: expand_keys, search_prefix, find_artworks", "look into resolve errors: 1 failures", "warm the vector index: 1"):
        assert part in got, part
    assert logs.codes_asked(logs.calls(lines)).first()["codes"] == 3
    assert logs.between(logs.calls(lines), "2026-01-02", "2026-01-02").count() == 1


def test_breakdown(lines):
    got = {(r["tool"], r["aspect"], r["key"]): r["n"] for r in logs.breakdown(logs.calls(lines)).collect()}
    assert got[("search", "mode", "keyword")] == got[("search", "query", "horse")] == 2 and got[("search", "mode", "semantic")] == 1
    assert got[("resolve", "batch", "3")] == got[("browse", "depth", "2")] == got[("browse", "notation", "73D")] == 1
    top = logs.top_per_aspect(logs.breakdown(logs.calls(lines)), 1).where("aspect = 'mode'").collect()
    assert [(r["key"], r["n"]) for r in top] == [("keyword", 2)]
    t = logs.totals(logs.calls(lines)).first()
    assert (t["calls"], t["errors"], t["error_percent"], t["sessions"]) == (5, 1, 20.0, 3)
    none = logs.calls(lines).where("ord < 0")
    assert logs.breakdown(none).count() == 0 and logs.totals(none).first()["calls"] == 0


def test_report_lists_are_whole_unless_bounded(spark, lines):
    many = lines.unionByName(spark.createDataFrame([(1000 + i, json.dumps({"timestamp": f"2026-02-01T10:{i // 60:02d}:{i % 60:02d}Z", "tool": "browse", "ms": 1, "ok": False, "error": f"E{i}"})) for i in range(70)], "ord long, value string"))
    whole, cut = logs.report(many), logs.report(many, most=5)
    assert whole.count("| E") == 70 and cut.count("| E") == 4


def test_percentile_definition(spark):
    df = spark.createDataFrame([("a", x) for x in (1, 2, 3, 4)] + [("b", 7)], "g string, x int")
    got = {r["g"]: r for r in stats.describe(df, "x", ["g"], (50, 99)).collect()}
    assert (got["a"]["p50"], got["a"]["p99"], got["b"]["p50"]) == (3, 4, 7)


@pytest.mark.parametrize("n,want", [(0, "0"), (1, "1-25"), (25, "1-25"), (26, "26-50"), (100, "51-100"), (200, "101-200"), (201, "201+")])
def test_buckets(spark, n, want):
    assert spark.range(1).select(stats.bucket(F.lit(n)).alias("b")).first()["b"] == want


def test_scalars(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert one(scalars.encode_uri_component(F.lit("a b(+1)é'!~*/"))) == "a%20b(%2B1)%C3%A9'!~*%2F"
    assert one(scalars.nested_url(F.lit("25F(+1)"), "u={code}")) == "u=25F%2528%252B1%2529"
    assert one(scalars.templated_url(F.lit("x/{notation}/{notation}"), F.lit("a b"))) == "x/a%20b/{notation}"
    assert one(scalars.templated_url(F.lit(None).cast("string"), F.lit("a"))) is None
    assert scalars.like_prefix("a%_\\") == "a\\%\\_\\\\%"
    assert one(scalars.modifier_id(F.lit("11k46"))) == "+46" and one(scalars.modifier_id(F.lit("11"))) is None
    assert one(scalars.title_label(F.lit("some-cat_one"))) == "Some Cat One"
    assert one(scalars.fixed_keyword(F.lit("de"), F.lit("Klaü"))) == "Klaue" and one(scalars.fixed_keyword(F.lit("en"), F.lit("Klaü"))) == "Klaü"
    assert one(scalars.duration_text(F.lit(59))) == "0m 59s" and one(scalars.duration_text(F.lit(7261))) == "2h 1m"
    assert one(scalars.tokens(F.lit("Müller's CAFÉ-bar Ø 9x"))) == ["muller", "s", "cafe", "bar", "ø", "9x"]
    assert one(scalars.canonical_object(F.lit('{"b":1,"a":2}'))) == one(scalars.canonical_object(F.lit('{"a":2, "b":1}')))
    line = scalars.entry_line(F.lit("7"), F.lit("Bible"), F.array(F.lit("x"), F.lit("y")), F.array(F.lit("1"), F.lit("2")), "* ")
    assert one(line) == '* 7 (x, y) "Bible" [1 > 2]'


def test_near_codes_and_prefixes(spark):
    codes = spark.createDataFrame([("A1",)], "code string")
    got = {r["candidate"]: (r["kind"], r["pos"]) for r in hierarchy.near_codes(codes).collect()}
    assert got["B1"] == ("sub", 1) and got["A2"] == ("sub", 2) and got["A"] == ("del", 2) and got["1"] == ("del", 1)
    assert got["A11"] == ("ins", 2) and "A1" not in got and "AA" not in got and got["0A1"] == ("ins", 1)
    known = spark.createDataFrame([("7",), ("73D",), ("73D6",)], "notation string")
    asked = spark.createDataFrame([("73D6",), ("73X",), ("9",), ("73D61",)], "code string")
    assert {r["code"]: r["ancestor"] for r in hierarchy.longest_prefix(asked, known).collect()} == {"73D6": "73D", "73X": "7", "9": None, "73D61": "73D6"}


def test_ingest(spark, tmp_path):
    for lang in ("en", "de"):
        for kind in ("txt", "kw"):
            (tmp_path / kind / lang).mkdir(parents=True)
    (tmp_path / "txt/en/txt_en_0.txt").write_text("7|Bible\n73|a|b\nbad line\n|x\ny|\n7|The Bible\n25F|beasts\n")
    (tmp_path / "txt/en/txt_en_keys.txt").write_text("25k1|male\n")
    (tmp_path / "kw/de/kw_de_0.txt").write_text("7|Klaü\n7|Buch\n7|Buch\n")
    got = {(r["notation"], r["lang"]): r["text"] for r in ingest.labels(spark, str(tmp_path / "txt")).collect()}
    assert got == {("7", "en"): "The Bible", ("73", "en"): "a|b", ("25F", "en"): "beasts"}
    assert [tuple(r) for r in ingest.key_labels(spark, str(tmp_path / "txt")).collect()] == [("25k1", "en", "male")]
    assert [r["keyword"] for r in ingest.keywords(spark, str(tmp_path / "kw")).orderBy("ord").collect()] == ["Klaue", "Buch", "Buch"]
    with gzip.open(tmp_path / "codes.gz", "wt") as f:
        f.write("7\n\n 73 \n")
    assert [r[0] for r in ingest.codes(spark, str(tmp_path / "codes.gz")).collect()] == ["7", "73"]
    (tmp_path / "c").mkdir()
    (tmp_path / "c/my-cat-counts.csv").write_text("notation,count\n7,3\n73,0\n7\n25F,x\n7,5\n")
    counts = ingest.collection_counts(spark, str(tmp_path / "c"))
    assert [tuple(r) for r in counts.collect()] == [("my-cat", "7", 5)]
    assert ingest.collection_info(counts).first()["label"] == "My Cat"
    raw = [("25F(+1)", ["25F", "25F(+1)"], [], [], "25F", "25k1", ["2"]), ("25F", ["25F"], ["25F1", "25F(...)"], ["7"], None, None, [])]
    nodes = ingest.structure(spark.createDataFrame(raw, "notation string, path array<string>, children array<string>, refs array<string>, base string, key string, modifiers array<string>"))
    a, b = nodes.orderBy("notation").collect()
    assert (a["children"], a["path"], a["is_key_expanded"]) == (["25F1"], [], False)
    assert (b["children"], b["path"], b["base_notation"], b["key_id"]) == (["25F(+2)"], ["25F"], "25F", "+1")
    made = ingest.composed_labels(nodes, ingest.labels(spark, str(tmp_path / "txt")), ingest.key_labels(spark, str(tmp_path / "txt")))
    assert [tuple(r) for r in made.collect()] == [("25F(+1)", "en", "beasts (+ male)")]
    (tmp_path / "replay.tsv").write_text('# c\nsearch\t{"query":"a"}\nbad\t{x\nnone\n')
    assert [r["tool"] for r in ingest.replay(spark, str(tmp_path / "replay.tsv")).collect()] == ["search"]


def test_composite_text(spark):
    from . import vocab

    v = vocab.vocabulary(spark)
    got = {r["notation"]: r["text"] for r in ingest.composite_text(v.notations, v.texts, v.keywords).collect()}
    assert got["7"] == "[Description] Bible [Keywords] scripture" and got["73"] == "[Description] New Testament [Category] Bible"
    assert "25F23(+1)" not in got and "11H000" not in got and got["11H00"] == "[Description NL] heilige 0 [Category] saints"


def test_mappings_with_fields(spark):
    from arbolex.operators import overlay

    mappings = spark.createDataFrame([(1, 5, 2), (1, 5, 2), (2, 5, 2), (3, 5, 9), (3, 6, 2)], "artwork_id long, vocab_rowid long, field_id long")
    vocabulary = spark.createDataFrame([(5, "classification", "7"), (6, "place", "73")], "vocab_int_id long, type string, notation string")
    fields = spark.createDataFrame([(2, "subject"), (9, "other")], "id long, name string")
    assert [tuple(r) for r in overlay.counts_per_code(mappings, vocabulary, fields).collect()] == [("7", 2)]


def test_export(spark, tmp_path):
    store.export_counts(spark.createDataFrame([("7", 2)], "notation string, count long"), str(tmp_path / "out"))
    assert next((tmp_path / "out").glob("*.csv")).read_text() == "notation,count\n7,2\n"


def test_streams_restart(spark, tmp_path):
    src, out, check = (str(tmp_path / x) for x in ("src", "out", "check"))
    schema = "ts timestamp, tool string, ms long, ok boolean"
    make = lambda rows: spark.createDataFrame(rows, "ts string, tool string, ms long, ok boolean").withColumn("ts", F.col("ts").cast("timestamp"))
    make([("2026-01-01 10:00:00", "a", 5, True), ("2026-01-01 10:30:00", "a", 7, False)]).write.parquet(src)

    def run():
        calls = spark.readStream.schema(schema).parquet(src)
        usage.keep_written(usage.by_tool(calls), out, check, once=True).awaitTermination()
        return {r["tool"]: (r["calls"], r["errors"], r["total_ms"], r["max_ms"]) for r in spark.read.parquet(out).collect()}

    assert run() == {"a": (2, 1, 12, 7)}
    make([("2026-01-02 10:00:00", "a", 1, True), ("2026-01-02 10:00:00", "b", 1, True)]).write.mode("append").parquet(src)
    assert run() == {"a": (3, 1, 13, 7), "b": (1, 0, 1, 1)}
    rows = spark.read.schema(schema).parquet(src)
    assert {(str(r["day"]), r["calls"], r["errors"]) for r in usage.by_day(rows).collect()} == {("2026-01-01", 2, 1), ("2026-01-02", 2, 0)}
    assert sorted(r["calls"] for r in usage.sessions(rows).collect()) == [2, 2]


@pytest.fixture(scope="module")
def twice(spark, tmp_path_factory):
    """The smallest tables, with each event again under other ids and at the same times, as larger copies have them."""
    from .test_queries import DIR

    if not os.path.isdir(DIR):
        pytest.skip("no tables")
    path = str(tmp_path_factory.mktemp("twice"))
    for name in os.listdir(DIR):
        os.symlink(f"{DIR}/{name}", f"{path}/{name}")
    os.remove(f"{path}/events.parquet")
    rows = spark.read.parquet(f"{DIR}/events.parquet")
    shifted = [rows.withColumn("event_id", (F.col("event_id") + k * 100_000).cast(rows.schema["event_id"].dataType)) for k in range(4)]
    late = lambda df: df.withColumn("value", F.col("value") + 201)
    late(shifted[0].unionByName(shifted[1]).unionByName(shifted[2]).unionByName(shifted[3])).coalesce(1).write.parquet(f"{path}/events.parquet")
    return path


@pytest.mark.parametrize("name", ["file_calls", "log_report", "log_report_cells"])
def test_many_calls_at_one_time_and_many_errors(spark, twice, name):
    con = connection(twice)
    con.execute(f"CREATE OR REPLACE VIEW events AS SELECT * FROM read_parquet('{twice}/events.parquet/*.parquet')")
    assert con.sql("SELECT count(*) FROM events WHERE value > 200").fetchall()[0][0] > logs.MOST_LISTED
    assert differences(spark, con, twice, registry.QUERIES[name], registry.ORACLES[name]) is None
