"""Spelling variants against all pairs, counts against a plain count, and defined cases."""

import random
import re
import zlib
from collections import Counter

import pytest

from arbolex.llm import variants

from .fixtures import frame


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_counts(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate({c: c + 32 for c in range(65, 91)})
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}


def brute_groups(n):
    out = {}
    for w in n:
        close = [x for x in n if near(w, x)]
        best = min(close, key=lambda x: (-n[x], x.encode()), default=None)
        out[w] = (best if best is not None and n[best] >= 5 * n[w] else None, len(close))
    rows = set()
    for w, (form, k) in out.items():
        root = w
        while out[root][0] is not None:
            root = out[root][0]
        rows.add((w, form, root, n[w], k, n[form] if form else None))
    return rows


def as_rows(df):
    return {(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


def vocabulary(seed, size, letters="abé"):
    rng, out = random.Random(seed), {}
    for _ in range(size):
        w = "".join(rng.choice(letters) for _ in range(rng.randrange(6, 10)))
        out[w] = rng.choice((5, 6, 25, 30, 125, 700, 3500))
    return out


@pytest.mark.parametrize("seed, size, letters", [(1, 250, "abé"), (2, 60, "ab"), (3, 300, "abcdefghÿ")])
def test_pairs_forms_and_roots(spark, seed, size, letters):
    n = vocabulary(seed, size, letters)
    df = spark.createDataFrame(list(n.items()), "word string, n long").repartition(5)
    pairs = variants.near_pairs(df).collect()
    got = [tuple(sorted((r["a"], r["b"]))) for r in pairs]
    assert len(got) == len(set(got)), "each pair once"
    assert set(got) == {tuple(sorted((a, b))) for a in n for b in n if a < b and near(a, b)}
    rows = as_rows(variants.grouped(df))
    assert rows == brute_groups(n)
    if seed < 3:
        assert any(form and root not in (form, w) for w, form, root, *_ in rows), "chains"


def test_long_chains_are_followed(spark):
    words = ["a" * (6 + k) for k in range(12)]
    df = spark.createDataFrame([(w, 5 ** (k + 1)) for k, w in enumerate(words)], "word string, n long")
    assert {r["word"]: r["root"] for r in variants.grouped(df).collect()} == {w: words[-1] for w in words}


def test_counts(spark):
    rng = random.Random(4)
    pool = ["Señora", "señora", "SEÑORA", "über×Maß", "straße", "ÀÉÎÕÜÿ÷", "letters", "Lettres", "short", "naïveté", "x" * 500, "ﬁgure", "œuvre", "Āngström"]
    texts = [" ".join(rng.choice(pool) + rng.choice(["", "1", "-", ".", "ß", "s"]) for _ in range(rng.randrange(400))) for _ in range(300)] + [None, "", " ", "é", "y" * 100_000]
    rows = [(None if k % 50 == 7 else k, t) for k, t in enumerate(texts)] + [(3, texts[3])] * 4
    docs = frame(spark, []).select("doc_id", "text").union(spark.createDataFrame(rows, "doc_id long, text string")).repartition(4)
    got = {r["word"]: r["n"] for r in variants.word_counts(docs).collect()}
    assert got == brute_counts(rows)
    assert any(w not in got for w in ("short",)) and as_rows(variants.grouped(variants.word_counts(docs))) == brute_groups(brute_counts(rows))
    assert variants.grouped(variants.word_counts(docs.limit(0))).count() == 0
