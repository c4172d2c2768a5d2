import hashlib
import random
import re
import tracemalloc

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from arbolex.llm import automata, fragments, induced

from .fixtures import corpus, frame, prose

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def plain(texts, symbols, window):
    """Kept flags of each text's symbols, by looking every window up in all earlier ones."""
    seen, out = set(), {}
    for k in sorted(texts):
        s = symbols(texts[k])
        keep = [True] * len(s)
        for i in range(len(s) - window + 1):
            w = tuple(s[i : i + window])
            if w in seen:
                keep[i : i + window] = [False] * window
            seen.add(w)
        out[k] = (s, keep)
    return out


def edited(seed=2):
    rng = random.Random(seed)
    texts = corpus(seed, 60)
    long = prose(rng, 400).split()
    for k in range(25):  # near copies: a few words differ, so fragments with one anchor are unlike
        w = list(long[k * 3 :])
        for _ in range(6):
            w[rng.randrange(len(w))] = f"e{rng.randrange(50)}"
        texts.append("  ".join(w))
    return [*texts, texts[1], "ab " * 500, "ab " * 300, "ab ab ac " * 100, "x" * 3000, "xy" * 900, "é" * 400]


#: As registered, and with all anchors hot that two unlike fragments share.
HOW = [{}, {"hot": 2, "sample": 1}]


@pytest.mark.parametrize("how", HOW)
def test_words_against_brute_force(spark, how):
    texts = edited()
    order = list(range(len(texts)))
    random.Random(1).shuffle(order)
    docs = frame(spark, [texts[k] for k in order]).repartition(5)
    ids = {k: texts[i] for k, i in enumerate(order)}
    got = {r["doc_id"]: r for r in fragments.deduplicated(docs, automata.KIND, **how).collect()}
    assert len(got) == len(texts)
    for k, (s, keep) in plain(ids, lambda t: WORD.findall((t or "").encode()), 20).items():
        kept = b" ".join(x for x, f in zip(s, keep) if f)
        assert (got[k]["n_words"], got[k]["n_removed"], got[k]["kept_sha256"]) == (len(s), len(s) - sum(keep), hashlib.sha256(kept).hexdigest()), k


def test_words_repeated_rows_and_no_rows(spark):
    docs = frame(spark, [prose(random.Random(3), 50)])
    rows = automata.passage_dedup(docs.unionByName(docs)).collect()
    assert len(rows) == 2 and {r["n_removed"] for r in rows} == {0}
    assert automata.passage_dedup(docs.where("doc_id < 0")).count() == 0


@pytest.mark.parametrize("dedup", [automata.passage_dedup, induced.byte_dedup])
def test_repeated_rows_beside_near_copies(spark, dedup):
    docs = frame(spark, edited()[60:90])
    want = {r["doc_id"]: r for r in dedup(docs).collect()}
    got = dedup(docs.unionByName(docs.where("doc_id % 2 = 1"))).collect()
    assert len(got) == 45 and all(r == want[r["doc_id"]] for r in got)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=12), max_size=5), st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=12))
def test_matching_statistics(passages, probe):
    a = automata.Automaton()
    for p in passages:
        a.add(p)
    inside = {tuple(p[i:j]) for p in passages for i in range(len(p)) for j in range(i, len(p) + 1)} | {()}
    want = [max(n for n in range(i + 2) if tuple(probe[i + 1 - n : i + 1]) in inside) for i in range(len(probe))]
    assert a.matching(probe) == want


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=80), st.integers(1, 9))
def test_sliding_min(v, w):
    if len(v) >= w:
        assert fragments.sliding_min(np.array(v, np.uint64), w).tolist() == [min(v[i : i + w]) for i in range(len(v) - w + 1)]


@pytest.mark.parametrize("how", HOW)
def test_bytes_against_brute_force(spark, how):
    texts = edited(5)
    got = {r["doc_id"]: r for r in fragments.deduplicated(frame(spark, texts).repartition(5), induced.KIND, **how).collect()}
    assert len(got) == len(texts)
    for k, (s, keep) in plain(dict(enumerate(texts)), lambda t: (t or "").encode(), 100).items():
        kept = bytes(x for x, f in zip(s, keep) if f)
        spans = sum(not f and (i == 0 or keep[i - 1]) for i, f in enumerate(keep))
        assert (got[k]["n_bytes"], got[k]["n_removed"], got[k]["n_spans"], got[k]["kept_sha256"]) == (len(s), len(s) - len(kept), spans, hashlib.sha256(kept).hexdigest()), k
    assert induced.byte_dedup(frame(spark, ["x"]).where("doc_id < 0")).count() == 0


def test_hot_anchors_are_the_commonest(spark):
    rng = random.Random(9)
    line = "the end of every licence reads like this line does here and so ends it all now"
    docs = frame(spark, [prose(rng, 30) + " " + line + " " + prose(rng, 30) for _ in range(60)] + [prose(rng, 60) for _ in range(60)])
    got = {most: fragments.hot_anchors(docs, automata.KIND, hot=20, sample=1, most=most) for most in (100, 1)}
    assert 1 <= len(got[100]) <= 12 and len(got[1]) <= 1 and np.isin(got[1], got[100]).all() and (np.diff(got[100]) > 0).all()
    assert not len(fragments.hot_anchors(docs.where("doc_id >= 60"), automata.KIND, hot=20, sample=1))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 40), st.integers(1, 4)), max_size=20))
def test_joined_runs_hold_the_same_windows(runs):
    places = fragments._places(*(np.array(x, np.int64) for x in (zip(*runs) if runs else ((), (), ()))))
    windows = lambda p: {(x, y + i) for x, y, z in p.tolist() for i in range(z)}
    joined = fragments._joined(places)
    assert windows(joined) == windows(places) and len(joined) <= len(places)


@pytest.mark.parametrize("dedup", [automata.passage_dedup, induced.byte_dedup])
def test_documents_without_an_id_or_with_one_id(spark, dedup):
    """A row is known by its doc_id and text: no row loses what only its namesake repeats."""
    rng = random.Random(31)
    p, x, y = (prose(rng, 50) for _ in range(3))
    texts = [(None, f"{p} {x}"), (None, f"{y} {p}"), (None, f"{y} {p}"), (7, x + " a"), (7, f"b {y}"), (7, prose(rng, 40)), (None, None), (None, "")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    got = {}
    for r in dedup(docs).collect():
        got.setdefault((r["doc_id"], r["kept_sha256"]), []).append(r)
    assert sum(map(len, got.values())) == len(texts)
    # Whichever of the two rows without an id is first keeps all; the other loses p only, row 7 what both hold.
    counts = sorted((r[1], r[2], r["doc_id"]) for rs in got.values() for r in rs if r["doc_id"] is None and r[1])
    whole, less = (100, 50) if dedup is automata.passage_dedup else (len(f"{p} {x}".encode()), len(p.encode()))
    assert sum(c[1] == 0 for c in counts) in (1, 2) and all(c[1] in (0, *range(less, less + 2)) for c in counts)
    assert len(counts) == 3


def _check_sort(text, memory=1 << 20):
    order, lcp = induced.induced_sort(np.array(text, np.uint16), 100, memory)
    n = len(text)
    assert sorted(order.tolist()) == list(range(n))
    suffix = [text[i:] for i in order.tolist()]
    for k in range(1, n):
        a, b = suffix[k - 1], suffix[k]
        same = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert a[:100] <= b[:100] or same >= 100
        assert lcp[k] == min(same, induced.CAP) or (same >= 100 and lcp[k] >= 100), (k, a, b, lcp[k])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60), st.integers(1, 6))
def test_induced_sort(text, times):
    _check_sort(text * times)


@pytest.mark.parametrize("batch", [3, 11])
def test_induced_sort_in_small_batches(monkeypatch, batch):
    monkeypatch.setattr(induced, "BATCH", batch)
    monkeypatch.setattr(induced, "RANGE", 4)
    rng = random.Random(batch)
    for n in (0, 1, 2, 3, 7, 50, 200):
        for top in (1, 2, 4, 256):
            _check_sort([rng.randint(0, top) for _ in range(n)] * rng.choice([1, 3]), memory=40)


def test_whole_shard_is_sorted_on_disk():
    """With the memory of production the queue spills, memory in use does not grow with the shard, and rows are right."""
    rng = random.Random(5)
    words = [bytes(rng.choices(b"abcdefghijklmnop ", k=rng.randint(3, 9))) for _ in range(3000)]
    peaks = []
    for size in (400_000, 4_000_000):
        contents, total = [], 0
        while total < size:
            contents.append(contents[rng.randrange(len(contents))][30:] + b" again" if contents and rng.random() < 0.2 else b" ".join(rng.choices(words, k=25)))
            total += len(contents[-1])
        text = np.frombuffer(b"\0".join(contents) + b"\0", np.uint8).astype(np.uint16)
        sort = induced.Suffixes(text, 100)
        tracemalloc.start()
        n = sum(map(len, sort.downwards()))
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert n == len(text)
        assert sort.spills > 0 or size < 4_000_000
    assert peaks[1] < 1.6 * peaks[0] + 2 * induced.MEMORY, peaks
    few = contents[:900]
    first, whole = induced._decide(few, np.ones(len(few), bool))
    seen, want = set(), set()
    for k, c in enumerate(few):
        want |= {(k, i) for i in range(len(c) - 99) if c[i : i + 100] in seen}
        seen |= {c[i : i + 100] for i in range(len(c) - 99)}
    assert {(f, a + i) for f, a, w in first.tolist() for i in range(w)} == want
    assert {(f, a + i) for f, a, w in whole.tolist() for i in range(w)} == {(k, i) for k, c in enumerate(few) for i in range(len(c) - 99)}


def test_induced_sort_with_little_memory():
    rng = random.Random(1)
    base = [rng.randrange(1, 5) for _ in range(150)]
    text = []
    for _ in range(12):
        w = list(base)
        w[rng.randrange(150)] = 6
        text += [*w, 0]
    _check_sort(text, memory=200)
    _check_sort([3] * 400 + [0] + [3] * 150 + [4] * 130)
