import re
import zlib

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from arbolex.llm import components, langid, simhash

from .fixtures import corpus, frame, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_print(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_components(prints):
    ids = sorted(prints)
    of = {k: k for k in ids}

    def root(k):
        while of[k] != k:
            k = of[k]
        return k

    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = root(a), root(b)
                of[max(x, y)] = min(x, y)
    return {k: root(k) for k in ids}


def test_simhash_against_brute_force(spark):
    texts = corpus(7, 60) + ["A b C", "a b c", "a  b\nc", "ÀB c", "a", "a b"]
    big = prose(__import__("random").Random(9), 3000).split()
    for k in range(12):  # near copies: one word differs
        texts.append(" ".join(big[:k * 50] + [f"w{k}"] + big[k * 50 :]))
    got = {r["doc_id"]: r for r in simhash.grouped(frame(spark, texts)).collect()}
    want = {k: plain_print(t) for k, t in enumerate(texts)}
    assert {k: r["fp"] % (1 << 64) for k, r in got.items()} == want
    assert {k: r["component_id"] for k, r in got.items()} == plain_components(want)


@pytest.mark.parametrize("most", [simhash.MOST, 3])
def test_links_connect_crowded_fingerprints(spark, most):
    rng = np.random.default_rng(4)
    weak = [0, 1, 7, 9, 15, 16, 20, 31, 33, 40, 47, 48, 55, 63]  # one template: most bits are the same in all
    crowd = [int(x) for x in {int(sum(1 << b for b in weak if rng.random() < 0.3)) ^ 0x5A5A << 20 for _ in range(250)}]
    prints = {i: x for i, x in enumerate(crowd + [int(x) for x in rng.integers(1, 1 << 62, 60)])}
    signed = [(i, x - (1 << 64) if x >> 63 else x) for i, x in prints.items()]
    edges = simhash.links(spark.createDataFrame(signed, "id long, fp long"), most=most).collect()
    assert all((prints[e["u"]] ^ prints[e["v"]]).bit_count() <= 2 for e in edges)
    of = {i: i for i in prints}

    def root(k):
        while of[k] != k:
            k = of[k]
        return k

    for e in edges:
        of[max(root(e["u"]), root(e["v"]))] = min(root(e["u"]), root(e["v"]))
    want = plain_components(prints)
    assert {k: root(k) for k in prints} == want and len(set(want.values())) < len(prints) - 100


def test_block_keys_do_not_mix(spark):
    """Fingerprints of one group have a pair of blocks, or with split groups 48 bits, in common."""
    rows = spark.createDataFrame([(i, i * 0x0001000100010001) for i in range(8)], "id long, fp long")
    spread = simhash.block_groups(rows)
    assert spread.select("key").distinct().count() == 48 and simhash.split_groups(spread, 0).select("key").distinct().count() == 8 * 36


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, (1 << 64) - 1), min_size=1, max_size=6), st.lists(st.tuples(st.integers(0, 5), st.integers(0, 63), st.integers(0, 63)), max_size=30))
def test_spanning_links_connect(base, flips):
    values = sorted({*base, *(base[k % len(base)] ^ (1 << a) ^ (1 << b) for k, a, b in flips)})
    edges = simhash.spanning_links(values)
    assert len(edges) < max(1, len(values)) + 1
    of = list(range(len(values)))

    def root(k):
        while of[k] != k:
            k = of[k]
        return k

    for a, b in edges:
        assert (values[a] ^ values[b]).bit_count() <= 2
        x, y = root(a), root(b)
        of[max(x, y)] = min(x, y)
    assert {k: root(k) for k in range(len(values))} == plain_components(dict(enumerate(values)))


def test_components(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (150, 2))] + [(1000 + k, 1001 + k) for k in range(70)] + [(5000, 5001 + k) for k in range(200)] + [(7, 7)]
    got = dict(tuple(r) for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect())
    of = {k: k for e in edges for k in e}

    def root(k):
        while of[k] != k:
            k = of[k]
        return k

    for a, b in edges:
        x, y = root(a), root(b)
        of[max(x, y)] = min(x, y)
    assert got == {k: root(k) for k in of if any(k in e and e[0] != e[1] for e in edges)}


def plain_code_length(text, counts, folded):
    """Walks the context trees of one language; counts: context -> {byte: n}, contexts of 0 to 3 bytes."""
    total = 0.0
    data = b"   " + folded(text)
    for i in range(3, len(data)):
        for order in (3, 2, 1, 0, -1):
            if order < 0:
                total += 8
                break
            seen = counts.get(data[i - order : i])
            if not seen:
                continue
            n, d = sum(seen.values()), len(seen)
            if data[i] in seen:
                total -= np.log2(seen[data[i]] / (n + d))
                break
            total -= np.log2(d / (n + d))
    return total


def test_langid_exact_code_lengths(spark):
    langs = {k: "ab"[k % 2] for k in range(40)}
    texts = [("xa yé zq " if langs[k] == "a" else "UV wö xx ") * (1 + k % 5) for k in range(40)]
    docs = frame(spark, texts, langs=langs)
    model = langid.train(docs)
    assert model.languages == ["a", "b"]
    fold = lambda t: bytes(c + 32 if 65 <= c <= 90 else c for c in t.lower().encode())
    for i, name in enumerate("ab"):
        counts = {}
        for k, t in enumerate(texts):
            if langs[k] == name and zlib.crc32(str(k).encode()) % 4 != 2:
                data = b"   " + t.lower().encode()
                for j in range(3, len(data)):
                    for order in range(4):
                        c = counts.setdefault(data[j - order : j], {})
                        c[data[j]] = c.get(data[j], 0) + 1
        for probe in ["xa uv", "é", "nothing known 12", "XX yé", ""]:
            data = np.frombuffer(probe.encode(), np.uint8)
            got = langid.code_lengths(model, model.index(), data, np.array([0, len(data)]))[0, i]
            assert got == pytest.approx(plain_code_length(probe.lower(), counts, lambda t: t.encode()), rel=1e-4, abs=1e-3)


def test_langid_rows(spark):
    langs = {k: ["a", "b", None][k % 3] if k < 60 else None for k in range(64)}
    texts = [{"a": "der die das und ", "b": "le la les des ", None: "der und das "}[langs[k]] * 4 for k in range(60)] + [None, "", "12 !!", "é"]
    rows = {r["doc_id"]: r for r in langid.identify(frame(spark, texts, langs=langs)).collect()}
    assert len(rows) == len(texts)
    assert all(rows[k]["lang_pred"] == (langs[k] or "a") for k in range(60))
    assert [rows[k]["lang_pred"] for k in (60, 61, 62)] == ["und"] * 3 and rows[63]["lang_pred"] in "ab"
    assert all(0 <= r["score"] <= 1 for r in rows.values())


def test_langid_learnable_rows_without_text(spark):
    docs = frame(spark, ["", "hello there", None, "12 !"], first=1, langs={1: "en", 2: None, 3: "de", 4: None})
    assert {(r["lang_pred"], r["score"]) for r in langid.identify(docs).collect()} == {("und", 0.0)}
    assert langid.determined(docs).count() == 0


def test_langid_many_languages(spark):
    """No language is left out, whatever the size of the sample; of each at least one document is drawn."""
    rng = __import__("random").Random(3)
    letters = "abcdefghijklmnopqrstuvwxyz"
    pools = ["".join(rng.sample(letters, 5)) for _ in range(230)]
    texts = [" ".join("".join(rng.choice(p) for _ in range(4)) for _ in range(40)) for p in pools for _ in range(6)]
    langs = {k: f"l{k // 6:03d}" for k in range(len(texts))}
    docs = frame(spark, texts, langs=langs)
    model = langid.train(docs, cells=1)
    assert model.languages == [f"l{k:03d}" for k in range(230)]
    got = langid.identify(docs, model).collect()
    assert sum(r["lang_pred"] == langs[r["doc_id"]] for r in got) > 0.8 * len(texts)


def test_empty_tables(spark):
    docs = frame(spark, ["x"]).where("doc_id < 0")
    assert langid.identify(docs).count() == 0
    assert simhash.grouped(docs).count() == 0
