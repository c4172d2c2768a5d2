import json

import pytest

from arbolex.operators import engine as api
from arbolex.operators import hierarchy, text, vector
from arbolex.sources import store

from . import vocab


@pytest.fixture(scope="module")
def lines():
    return []


@pytest.fixture(scope="module")
def engine(spark, lines):
    v = vocab.vocabulary(spark)
    for name in ("notations", "texts", "keywords", "counts", "label_index", "keyword_index"):
        setattr(v, name, getattr(v, name).coalesce(2).cache())
    return api.Engine(v, vocab.embed, emit=lines.append)


def codes(result):
    return [e["notation"] for e in result]


def test_search_phrase_and_fallback(engine):
    got = engine.search(query="Passion of Christ")
    assert got["total"] == 1 and codes(got["results"]) == ["73D"] and got["results"][0]["collections"] == ["a-cat", "b_cat"]
    assert engine.search(query="trumpet angel")["total"] == 2  # no phrase, but both words
    assert engine.search(query="angel", parent="73d")["total"] == 2 and engine.search(query="angel", parent="25")["total"] == 0
    assert engine.search(query="ETAPE")["total"] == 8
    assert engine.search(query="scripture")["results"][0]["notation"] == "7"


def test_search_totals_count_what_cannot_be_resolved(engine):
    got = engine.search(query="ghost")
    assert got["total"] == 1 and got["results"] == []


def test_search_presence(engine):
    assert engine.search(query="beasts of prey", only_held=True)["total"] == 1
    assert codes(engine.search(query="beasts of prey")["results"])[0] == "25F23"
    assert engine.search(query="beasts of prey", collection="b_cat")["total"] == 0


def test_semantic(engine):
    got = engine.search(semantic="the bible", max_results=2)
    assert codes(got["results"]) == ["7", "73"] and got["total"] == 2 and got["results"][0]["similarity"] > 0.99
    assert codes(engine.search(semantic="the bible", only_held=True)["results"]) == ["73D", "25F23"]
    assert codes(engine.search(semantic="x", parent="7")["results"])[-1] == "7"


@pytest.mark.parametrize("args", [{}, {"query": "a", "semantic": "b"}, {"query": "null"}, {"query": "a", "max_results": 0}, {"query": "a", "max_results": 51}, {"query": "a", "lang": "xx"}, {"query": "a", "offset": -1}])
def test_search_rejects(engine, args):
    with pytest.raises(api.InvalidArgument):
        engine.search(**args)


def test_browse(engine):
    got = engine.browse("73D", depth=1, lang="de")
    assert got["entry"]["text"] == "Leiden Christi" and [p["text"] for p in got["entry"]["path"]] == ["Bible", "New Testament"]
    assert codes(got["subtree"]) == [f"73D{i}" for i in (1, 2, 3, 5, 6, 7, 8, 9)]
    assert [(r["notation"], r["text"]) for r in got["refs"]] == [("7", "Bible"), ("NOPE", None)]
    assert len(got["entry"]["keywords"]) == 40 and got["entry"]["keywords"][39] == "keyword 39"
    with pytest.raises(api.InvalidArgument):
        engine.browse("NOPE")
    keys = engine.browse("25F23", include_keys=True, max_key_variants=2)
    assert codes(keys["key_variants"]) == ["25F23(+1)", "25F23(+2)"] and keys["total_key_variants"] == 3
    assert engine.browse("25F23(+1)", include_keys=True)["total_key_variants"] == 0


def test_browse_caps(engine):
    got = engine.browse("11H", depth=2)["subtree"]
    assert len(got) == 250 and codes(got)[:3] == ["11H00", "11H000", "11H001"]
    assert engine.browse("11H", depth=1)["subtree"][0] | {} == engine.browse("11H", depth=1)["subtree"][0]
    assert len(engine.browse("11H", depth=1)["subtree"]) == 25
    tops = engine.browse("7", depth=3)["subtree"]
    assert [(e["notation"], e["depth"]) for e in tops][:3] == [("73", 1), ("73D", 2), ("73D1", 3)]


def test_subtree_truncated(spark):
    nodes = spark.createDataFrame([("r", ["a"]), ("a", [f"a{i}" for i in range(30)])] + [(f"a{i}", []) for i in range(30)], "notation string, children array<string>")
    got = hierarchy.subtree(nodes, nodes.where("notation = 'r'"), 2).collect()
    assert (got[0]["total_children"], got[0]["truncated"], len(got)) == (30, True, 26)


def test_resolve(engine):
    got = engine.resolve(["73D1", "NOPE", "7", "73D1"], lang="fr")
    assert codes(got) == ["73D1", "7", "73D1"] and got[0]["text"] == "étape 1"
    assert engine.resolve(["73D82(CROSS)"])[0]["text"] == "cruz" and engine.resolve(["11H000"])[0]["text"] == "11H000"
    assert engine.resolve(["25F23"], lang="en")[0]["keywords"] == ["Raubtier", "fauve"]
    assert engine.resolve(["7"])[0]["keywords"] == ["scripture", "scripture"]
    with pytest.raises(api.InvalidArgument):
        engine.resolve(["NOPE"])
    with pytest.raises(api.InvalidArgument):
        engine.resolve([])


def test_expand_keys(engine):
    got = engine.expand_keys("25F23", offset=1)
    assert codes(got["key_variants"]) == ["25F23(+2)", "25F23(+46)"] and got["total_key_variants"] == 3
    for bad in ("25F23(+1)", "NOPE"):
        with pytest.raises(api.InvalidArgument):
            engine.expand_keys(bad)


def test_search_prefix(engine):
    assert engine.search_prefix("25f23")["total"] == 5 and codes(engine.search_prefix(" 25F23(l ")["results"]) == ["25F23(LION)"]
    assert codes(engine.search_prefix("25G%_\\")["results"]) == ["25g%_\\x"] and engine.search_prefix("25g%%")["total"] == 0
    assert engine.search_prefix("  ")["total"] == 0 and codes(engine.search_prefix("73", collection="a-cat")["results"]) == ["73D", "73D1"]
    assert codes(engine.search_prefix("73D", max_results=2, offset=2)["results"]) == ["73D2", "73D3"]


def test_find_artworks(engine):
    got = engine.find_artworks(["73D", "NOPE", "25F23"])
    assert codes(got) == ["73D", "NOPE", "25F23"] and got[1] == {"notation": "NOPE", "text": "NOPE", "collections": [], "aggregator_url": "https://example.org/resource/?uri=NOPE"}
    assert [(c["label"], c["count"], c["url"]) for c in got[0]["collections"]] == [("B Cat", 9, None), ("A Cat", 5, "https://a.example/73D")]


def test_health_and_log(engine, lines):
    assert engine.health()["collections"] == ["a-cat", "b_cat", "c"]
    assert [c["known_notations"] for c in engine.collections()] == [3, 1, 0]
    engine.resolve(notations=["7"] * 8)
    last = json.loads(lines[-1])
    assert last["tool"] == "resolve" and last["ok"] and last["input"]["notations"][-1] == "+3 more"


def test_store_round_trip(spark, tmp_path):
    v = vocab.vocabulary(spark)
    store.write(v, str(tmp_path))
    e = api.Engine(store.open_store(spark, str(tmp_path)))
    assert e.search_prefix("73D")["total"] == 10 and e.search(query="angel")["total"] == 2
    import shutil

    for name in ("counts", "info", "embeddings"):
        shutil.rmtree(tmp_path / name)
    e = api.Engine(store.open_store(spark, str(tmp_path)))
    assert e.collections() == [] and e.resolve(["73D"])[0]["collections"] == [] and e.search_prefix("7", collection="a-cat")["total"] == 0
    with pytest.raises(api.InvalidArgument):
        e.search(semantic="x")


def test_describe_entry(engine):
    e = engine.resolve(["73D"])[0]
    assert api.describe_entry(e, "- ") == '- 73D (a-cat, b_cat) "Passion of Christ" [7 > 73]'


@pytest.mark.parametrize("query,phrase,terms", [("dog", '"dog"', None), ("a*b (c)", '"ab c"', '"a" AND "b" AND "c"'), ('say "hi"', '"say ""hi"""', '"say" AND "hi"'), ("  ", None, None), ("*.^", None, None), ("a/b", '"a/b"', '"a" AND "b"'), ("animal(s)", '"animals"', '"animal" AND "s"')])
def test_query_forms(query, phrase, terms):
    assert (text.phrase_of(query), text.terms_of(query)) == (phrase, terms)


def test_bm25_against_fts5(spark):
    """The ranks are those of a full-text engine with the same defaults."""
    import random
    import sqlite3

    rng = random.Random(1)
    pool = ["angel", "Müller", "café", "horse-back", "the", "of", "lion", "ÉTÉ", "x9"]
    docs = [" ".join(rng.choice(pool) for _ in range(rng.randint(1, 12))) for _ in range(200)]
    db = sqlite3.connect(":memory:")
    try:
        db.execute("create virtual table t using fts5(body)")
    except sqlite3.OperationalError:
        pytest.skip("no full-text engine")
    db.executemany("insert into t(rowid, body) values (?, ?)", enumerate(docs))
    index = text.token_table(spark.createDataFrame(list(enumerate(docs)), "id long, body string"), "body", "id").cache()
    for q in ("the angel", "muller cafe", "of the", "horse back", "lion ete"):
        for expr, phrases in ((text.phrase_of(q), text.phrase_tokens(q)), (text.terms_of(q), text.term_tokens(q))):
            want = {r[0]: r[1] for r in db.execute("select rowid, rank from t where t match ?", (expr,))}
            got = {r["id"]: r["rank"] for r in text.search(index, phrases).collect()}
            assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want), expr


def test_vectors(spark):
    from pyspark.sql import functions as F

    one = spark.range(1)
    v = F.array(F.lit(3.0), F.lit(4.0), F.lit(12.0))
    got = one.select(vector.truncated(v, 2).alias("a"), vector.truncated(v, 0).alias("b"), vector.truncated(v, 9).alias("c"), vector.quantized(F.array(F.lit(1.5), F.lit(-0.5), F.lit(-2.0))).alias("q")).first()
    assert got["a"] == pytest.approx([0.6, 0.8]) and got["b"] == got["c"] == [3.0, 4.0, 12.0] and list(got["q"]) == [127, -63, -127]
    assert vector.quantize_query([3.0, 4.0]) == [76, 101] and vector.quantize_query([0.0, -1.0]) == [0, -128]
    assert list(one.select(vector.quantized_query(F.array(F.lit(0.6), F.lit(0.8))).alias("q")).first()["q"]) == [76, 101]
    assert vector.counts_agree(None, 3) and vector.counts_agree(float("nan"), 3) and not vector.counts_agree(4, 3)


def test_embedding_in_batches(spark):
    from pyspark.sql import functions as F

    import numpy as np

    seen = lambda texts: np.array([[len(x) / 10, -0.5] for x in texts])
    rows = spark.createDataFrame([(f"c{i}", "x" * (i % 9)) for i in range(40)] + [("none", None)], "notation string, text string")
    got = {r["notation"]: list(r["embedding"]) for r in vector.embedded(rows, seen, batch=7).collect()}
    assert len(got) == 41 and got["c3"] == [38, -63] and got["none"] == [0, -63]
    done = vector.embedded(rows.limit(10), seen)
    assert store.resume(rows, done, done).count() == 31
    assert vector.embedded(rows.where(F.lit(False)), seen).count() == 0


def test_publish_keeps_the_old_store_if_the_new_one_is_no_good(spark, tmp_path):
    path = str(tmp_path / "store")
    v = vocab.vocabulary(spark)
    assert store.publish(v, path)
    n = store.open_store(spark, path).notations.count()
    assert n and store.publish(store.open_store(spark, path), path) and store.open_store(spark, path).notations.count() == n
    empty = store.vocabulary(spark, notations=v.notations.where("false"), texts=v.texts)
    assert not store.publish(empty, path) and store.open_store(spark, path).notations.count() == n
    assert [p.name for p in tmp_path.iterdir()] == ["store"]
