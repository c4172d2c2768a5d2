"""Spelling variants: words one edit apart, by an even-partition pigeonhole join.

A word of n code points is cut into two segments, of n // 2 code points and the rest. One edit leaves one of the two whole.
So every word is indexed by its two segments under (length, which segment, its text), and probes the index of its own
length and of the next shorter one with its substrings: the first segment can only stand at the start, the second at its
own place or, in a longer word, one further on. A pair found by both segments is kept at the first only, and what is left
is verified: exactly one inserted, deleted or replaced code point. Candidates are verified where they are joined and never
written, so a segment that many words share costs comparisons but no rows; a hot one is split by the join's skew handling.

Counting happens in numpy over the bytes of whole texts: of a document's runs of letters each distinct one leaves a task
once with its number, and Spark sums these before and after the shuffle.

Defined cases: a null text has no words; a null doc_id counts as an empty one in the rule that garbles runs; repeated rows
count each; a word without a near word of enough weight has no form and is its own root; an empty table gives no rows;
other columns, whatever their names, are ignored. A form has at least ``RATIO`` times its word's n, so chains of forms are
short (at most 27 steps for 63-bit counts) and are followed by doubling, five rounds at most.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BYTE_VALUES, Chunk, checkpointed, chunks, documents, runs, word_hashes

MIN_LENGTH, MIN_COUNT, RATIO = 6, 5, 5
GARBLED = 199  # a run whose checksum this divides loses a code point
_ASCII = bytes(range(256)).lower()  # A to Z only

_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True


def letter_bytes(data: np.ndarray) -> np.ndarray:
    """Which bytes of UTF-8 belong to code points of ``[A-Za-z\\u00C0-\\u00FF]``."""
    inside = _LETTER[data]
    lead = np.flatnonzero(data == 0xC3)  # what follows it is 0x80 to 0xBF: U+00C0 to U+00FF
    inside[lead] = True
    inside[lead[lead + 1 < len(data)] + 1] = True
    return inside


def garbled(doc_id: int | None, run: bytes) -> bytes:
    """The rule that plants misspellings: a run whose checksum with its doc_id is divisible loses one code point."""
    h = zlib.crc32(b"%d:%b" % (doc_id, run) if doc_id is not None else b":" + run)
    if h % GARBLED:
        return run
    letters = run.decode()
    at = h % len(letters)
    return (letters[:at] + letters[at + 1 :]).encode()


def _counted(chunk: Chunk, ids: list) -> Counter:
    """The words of a chunk, garbled by document."""
    data = np.frombuffer(chunk.data.tobytes().translate(_ASCII), np.uint8)
    found = runs(letter_bytes(data), chunk.offsets)
    if not len(found.start):
        return Counter()
    hashes = word_hashes(Chunk(chunk.rows, data, chunk.offsets), found, BYTE_VALUES)
    out: Counter = Counter()
    text = data.tobytes()
    for k in np.flatnonzero(found.count):
        lo, hi = found.first[k], found.first[k + 1]
        _, at, n = np.unique(hashes[lo:hi], return_index=True, return_counts=True)
        at += lo
        for s, e, c in zip(found.start[at].tolist(), found.end[at].tolist(), n.tolist()):
            out[garbled(ids[k], text[s:e])] += c
    return out


def word_counts(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, garble: bool = True) -> DataFrame:
    """word and n: lower-cased runs of letters of all whole texts, of at least so many code points and occurrences."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for chunk in chunks(batch.column("text")):
                got = _counted(chunk, ids[chunk.rows.start : chunk.rows.stop] if garble else [None] * chunk.n)
                got = {w: c for w, c in got.items() if len(w) >= min_length}
                yield pa.record_batch({"word": pa.array([w.decode() for w in got], pa.string()), "n": pa.array(list(got.values()), pa.int64())})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(count, "word string, n long")
    rows = rows.where(F.length("word") >= min_length)
    return rows.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def _halves(word: Column, size: Column) -> list[tuple[Column, Column]]:
    """Where the two segments of a word of ``size`` code points begin (from 1) and how long they are."""
    half = F.floor(size / 2).cast("int")
    return [(F.lit(1), half), (half + 1, size - half)]


def near_pairs(words: DataFrame) -> DataFrame:
    """a and b, each pair once: words that differ by one inserted, deleted or replaced code point. b is the longer one, or of
    two as long the greater one. words: word and n; n_a and n_b come along."""
    size = F.length("word")
    segment = lambda place, start, length: F.struct(F.lit(place).alias("place"), F.substring(F.col("word"), start, length).alias("segment"))
    index = words.select(F.col("word").alias("a"), F.col("n").alias("n_a"), size.alias("size"), F.inline(F.array(*(segment(k, *h) for k, h in enumerate(_halves(F.col("word"), size))))))
    probes = []
    for longer in (0, 1):
        (_, first), (second, rest) = _halves(F.col("word"), size - longer)
        entry = lambda place, start, length, longer=longer: F.struct((size - longer).alias("size"), F.lit(place).alias("place"), F.substring(F.col("word"), start, length).alias("segment"))
        probes += [entry(0, F.lit(1), first), entry(1, second + longer, rest)]
    probe = words.select(F.col("word").alias("b"), F.col("n").alias("n_b"), F.inline(F.array(*probes)))
    both = index.join(probe, ["size", "place", "segment"])
    # The second segment's candidates whose first ones agree too have been found by the first.
    half = F.floor(F.col("size") / 2).cast("int")
    again = (F.col("place") == 1) & (F.substring(F.col("a"), F.lit(1), half) == F.substring(F.col("b"), F.lit(1), half))
    once = (F.length("b") > F.col("size")) | (F.col("a") < F.col("b"))
    return both.where(once & ~again & (F.levenshtein("a", "b", 1) == 1)).select("a", "n_a", "b", "n_b")


def roots(forms: DataFrame) -> DataFrame:
    """word and root: where the forms lead in the end. forms: word and form, only those that have one."""
    jumps = checkpointed(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = jumps.select(F.col("word").alias("root"), F.col("root").alias("_further"))
        jumps = checkpointed(jumps.join(ahead, "root", "left").select("word", F.coalesce("_further", "root").alias("root"), F.col("_further").isNotNull().alias("moved")))
        moved = not jumps.where("moved").isEmpty()
        jumps = jumps.select("word", "root")
        if not moved:
            return jumps


def grouped(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near and form_n of each word. words: word and n."""
    words = checkpointed(words)
    pairs = near_pairs(words)
    each = pairs.select(F.inline(F.array(*(F.struct(F.col(x).alias("word"), F.col(f"n_{x}").alias("n"), F.col(y).alias("near"), F.col(f"n_{y}").alias("near_n")) for x, y in (("a", "b"), ("b", "a"))))))
    best = each.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("o"), "near")).alias("best"))
    got = words.join(best, "word", "left")
    enough = -F.col("best.o") >= ratio * F.col("n")
    got = checkpointed(got.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(enough, F.col("best.near")).alias("form"), F.when(enough, -F.col("best.o")).alias("form_n")))
    ends = roots(got.where("form is not null"))
    return got.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_pigeonhole_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouped(word_counts(documents(spark, sf_dir)))
