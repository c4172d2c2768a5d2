import re
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash

from arbolex.llm import packing, quality, sharding

from .fixtures import corpus, frame

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_quality_against_brute_force(spark):
    texts = [*corpus(), "a b c d e a b c d e f", "x\ny\nx\n\n x\nx", "#*$%&|<> é", "p q r s t u v w x y z " * 3]
    got = {r["doc_id"]: r for r in quality.judged(frame(spark, texts)).collect()}
    assert len(got) == len(texts)
    for k, t in enumerate(texts):
        t = t or ""
        w = WORD.findall(t)
        r = got[k]

        def cover(n):
            grams = Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
            inside = set()
            for i in range(len(w) - n + 1):
                if grams[tuple(w[i : i + n])] > 1:
                    inside.update(range(i, i + n))
            return inside

        seen, dup = set(), 0
        for line in t.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        rep = len(cover(5))
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, rep), k
        assert r["base_failed"] == (len(w) < 10 or 100 * rep > 20 * len(w))
        for n in quality.COVERAGE:
            assert r[f"chars_{n}"] == sum(len(w[i]) for i in cover(n))
        assert not (r["kept"] and r["base_failed"])


def test_sharding(spark):
    texts = corpus(3, 300) + ["same text"] * 150
    docs = frame(spark, texts)
    rows = sharding.shard(docs).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(len(texts)))
    sizes, slots, of = Counter(), defaultdict(list), {}
    for r in rows:
        t = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(t) + 16, zlib.crc32(t))
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        of[r["doc_id"]] = r["shard"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    longest = max(len((t or "").encode()) for t in texts) + 16
    assert max(sizes.values()) <= sum(sizes.values()) / 40 + longest
    assert {tuple(r) for r in rows} == {tuple(r) for r in sharding.shard(docs).collect()}


def test_sharding_against_brute_force(spark):
    """Shards and slots are those of the whole table in key order, whatever splitters the sample gave."""
    texts = [*corpus(4, 200), *["same text"] * 80, None, None]
    big = 1 << 60  # ids that a float would blur
    rows = [(None if k % 50 == 7 else big + k, t) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    signed = lambda t: (h := xxhash.xxh64_intdigest((t or "").encode(), 42)) - (1 << 64 if h >> 63 else 0)
    order = sorted((signed(t), i is not None, i or 0, t or "") for i, t in rows)
    total, at, want, slots = sum(len(t.encode()) + 16 for *_, t in order), 0, Counter(), Counter()
    for _, some, i, t in order:
        size = len(t.encode()) + 16
        s = min(39, int((at + size / 2) * 40 / total))
        want[i if some else None, zlib.crc32(t.encode()), s, slots[s]] += 1
        slots[s] += 1
        at += size
    got = Counter((r["doc_id"], r["text_crc32"], r["shard"], r["slot"]) for r in sharding.shard(docs).collect())
    assert got == want


def test_packing_of_repeated_and_nameless_rows(spark):
    rows = [(None, "a b c")] * 3 + [(None, None), (5, "x y"), (5, "x y"), (5, "z")]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), docs_a_group=2).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in rows) and sum(r["length"] for r in got) == sum(len(packing.token_ids(t or "")) + 1 for _, t in rows)


def plain_first_fit(sizes, length):
    """First-fit decreasing without a tree; the loads of the bins before gaps are filled."""
    loads = []
    for n in sorted(sizes, reverse=True):
        k = next((k for k, x in enumerate(loads) if x + n <= length), None)
        if k is None:
            loads.append(n)
        else:
            loads[k] += n
    return loads


def test_tournament_against_plain_first_fit():
    rng = __import__("random").Random(3)
    for _ in range(60):
        length = rng.choice([8, 50, 2048])
        sizes = [rng.randint(1, length) for _ in range(rng.randint(1, 80))]
        tree, loads = packing.Bins(len(sizes), length), []
        for n in sorted(sizes, reverse=True):
            k = tree.first(n)
            loads += [0] * (k + 1 - len(loads))
            loads[k] += n
            assert tree.room(k) == length - loads[k]
        assert loads == plain_first_fit(sizes, length)
        bins = packing.first_fit_decreasing(sizes, length)
        assert sorted((p, s + i) for b in bins for p, s, n in b for i in range(n)) == [(p, i) for p, n in enumerate(sizes) for i in range(n)]
        full = [sum(n for _, _, n in b) for b in bins]
        assert max(full) <= length and len(bins) == -(-sum(sizes) // length)


def test_packing_round_trip(spark):
    texts = [*corpus(5, 60), "abc <|endoftext|> def"]
    rows = packing.pack(frame(spark, texts), docs_a_group=20).collect()
    plain = packing._plain(packing._path(packing.VOCABULARY))
    ids = {k: [*plain.encode(t or "", add_special_tokens=False).ids, 1] for k, t in enumerate(texts)}
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
        by_seq[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(by_doc) == set(ids)
    for k, ps in by_doc.items():
        at = 0
        for s, n, crc, total in sorted(ps):
            part = b"".join(i.to_bytes(4, "little") for i in ids[k][s : s + n])
            assert s == at and n > 0 and crc == zlib.crc32(part) and total == len(ids[k])
            at += n
        assert at == len(ids[k])
    for ps in by_seq.values():
        at = 0
        for o, n in sorted(ps):
            assert o == at
            at += n
        assert at <= 2048


@pytest.mark.parametrize("text", ["", " ", "<|endoftext|>", "abc <|endoftext|> def", "<|endoftext|><|endoftext|>x<|endof", "é<|endoftext|>\n\n y", "a  b\n\n c\r\n", "😀é ñ", "x" * 500, " " * 500, "don't 12,345.67"])
def test_token_ids_agree(text):
    plain = packing._plain(packing._path(packing.VOCABULARY))
    assert packing.token_ids(text) == plain.encode(text, add_special_tokens=False).ids


def test_empty_tables(spark):
    docs = frame(spark, ["x"]).where("doc_id < 0")
    assert quality.judged(docs).count() == sharding.shard(docs).count() == packing.pack(docs).count() == 0
