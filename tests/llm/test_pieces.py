"""Encoding and decoding against the sentencepiece library, and the agenda's two forms against each other."""

import hashlib
import random

import pytest

from arbolex.llm import pieces

from .fixtures import corpus, frame


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Pieces(pieces.default_model())


def odd_texts(n=1500):
    rng = random.Random(3)
    some = [lambda: rng.randrange(32, 127), lambda: rng.randrange(0x80, 0x250), lambda: rng.randrange(0x4E00, 0x5000), lambda: 32, lambda: 0x2581, lambda: rng.randrange(0x1F600, 0x1F640), lambda: rng.choice((0, 9, 10, 13, 0x300, 0xFFFD))]
    return ["".join(chr(rng.choice(some)()) for _ in range(rng.randrange(80))) for _ in range(n)]


FIXED = ["", " ", "  ", "a  ", "\0", "▁a ▁", "😀😀", "x" * 3000, " " * 3000 + "e", "\n\n", "ab" * 5000, "日本語の長い文" * 300, "<s>", "<0x0A>", "</s> <unk>", "⁇", "a" * 60_000, " a", "a b", "a\nb  c"]


def test_ids_and_texts_are_the_librarys(vocabulary):
    texts = FIXED + odd_texts() + [t or "" for t in corpus(4)]
    ids = vocabulary.encode(texts)
    assert ids == vocabulary.library.encode(texts)
    assert [vocabulary.decode(i) for i in ids] == vocabulary.library.decode(ids)
    vocabulary.cache.clear()
    assert vocabulary.encode(texts[::-1]) == ids[::-1]


def test_any_ids_decode_as_in_the_library(vocabulary):
    rng = random.Random(5)
    for _ in range(800):
        ids = [rng.randrange(3, 259) if rng.random() < 0.4 else rng.randrange(32_000) for _ in range(rng.randrange(12))]
        assert vocabulary.decode(ids) == vocabulary.library.decode(ids), ids


def test_lockstep_and_heap_agree(vocabulary):
    units = list({u for t in odd_texts(300) for u in pieces._cut(t) if len(u) < pieces.LOCKSTEP})
    heaped = [vocabulary._as_ids(vocabulary._heap(vocabulary._symbols(pieces.MARK + u).tolist())) for u in units]
    assert [vocabulary.units({u})[u] for u in units[:50]] == heaped[:50]
    together = vocabulary.units(set(units))
    assert [together[u] for u in units] == heaped


def test_other_vocabularies_are_refused():
    with pytest.raises(Exception):  # noqa: B017  (the library's own error)
        pieces.Pieces(b"no model")


def test_rows_keep_their_columns(spark, vocabulary, monkeypatch):
    texts = [*FIXED, None, *[t or "" for t in corpus(2)][:30]]
    docs = frame(spark, texts).withColumnRenamed("h", "ids").withColumnRenamed("size", "agrees").repartition(3)
    got = pieces.detokenized(pieces.tokenized(docs))
    assert set(got.columns) == set(docs.columns) | {"decoded"} and got.schema["ids"].dataType.simpleString() == "array<int>"
    rows = {r["doc_id"]: r for r in got.collect()}
    for k, t in enumerate(texts):
        want = vocabulary.library.encode(t or "")
        assert rows[k]["text"] == t and rows[k]["ids"] == want and rows[k]["decoded"] == vocabulary.library.decode(want) and rows[k]["agrees"]
    monkeypatch.setattr(pieces, "_IDS", 100)
    assert pieces.tokenized(docs.limit(0)).count() == 0
    nothing = pieces.detokenized(spark.createDataFrame([(1, None), (2, [])], "k long, ids array<int>")).collect()
    assert [r["decoded"] for r in nothing] == ["", ""]


def test_query(spark, tmp_path, vocabulary):
    texts = [*FIXED, None, *odd_texts(50)]
    frame(spark, texts).coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in pieces.op11_score_agenda(spark, str(tmp_path)).collect()}
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for k, t in enumerate(texts):
        ids = vocabulary.library.encode(t or "")
        assert (got[k]["n_tokens"], got[k]["ids_sha256"], got[k]["decoded_sha256"], got[k]["agrees"]) == (len(ids), digest(",".join(map(str, ids))), digest(vocabulary.library.decode(ids)), True)
