"""Quality rules by repetition coverage.

Per document, rolling hashes of several n-gram lengths over its words and of its lines, in numpy, find what occurs
twice or more in the text; the share of the text's word characters that lies inside duplicated n-grams or lines decides.
A document is judged alone, so nothing is shuffled.

Defined cases: a null or empty text has no words and fails the base rule; repeated rows and ties are judged one by one;
an empty table gives no rows; other columns, whatever their names, are ignored. Hashes have 64 bits and are compared
within about 2 MB of text, so a false match is not to be expected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BYTE_VALUES, U64, Chunk, Words, chunks, documents, mixed, ngram_hashes, per_doc, run_hashes, prefix_sums, runs, words

#: n-gram length in words -> largest share of the word characters inside n-grams that occur twice or more.
COVERAGE = {5: 0.30, 7: 0.26, 10: 0.20}
LINE_COVERAGE = 0.30
BASE_WINDOW, MIN_WORDS, MAX_REPEAT_PERCENT = 5, 10, 20
SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>"))
HEADS = (np.arange(256) & 0xC0) != 0x80  # a byte that begins a code point


def _again(keys: np.ndarray) -> np.ndarray:
    """Which keys occur twice or more."""
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    same = s[1:] == s[:-1]
    twice = np.zeros(len(keys), bool)
    twice[order[1:]] = same
    twice[order[:-1]] |= same
    return twice


def covered(hashes: np.ndarray, w: Words, n: int) -> np.ndarray:
    """Which words lie in an n-word window of their document that occurs there twice or more."""
    total, doc = len(hashes), w.doc
    out = np.zeros(total + 1, np.int64)
    grams = ngram_hashes(hashes, n)
    if not len(grams):
        return np.zeros(total, bool)
    at = np.flatnonzero(doc[: len(grams)] == doc[n - 1 :])
    twice = at[_again(mixed(grams[at] + doc[at].astype(U64) * U64(0xD6E8FEB86659FD93)))]
    np.add.at(out, twice, 1)
    np.add.at(out, twice + n, -1)
    return np.cumsum(out[:-1]) > 0


def measures(chunk: Chunk) -> dict[str, np.ndarray]:
    """Counts by document."""
    w = words(chunk)
    prefix = prefix_sums(BYTE_VALUES[chunk.data])
    hashes = run_hashes(prefix, w.start, w.end)
    inside = np.zeros(len(chunk.data) + 1, np.int64)
    np.cumsum(HEADS[chunk.data], out=inside[1:])
    chars = inside[w.end] - inside[w.start]
    out = {
        "n_words": w.count,
        "word_chars": per_doc(chars, w.first),
        "n_symbols": per_doc(SYMBOLS[chunk.data].astype(np.int64), chunk.offsets),
        "n_repeat_words": per_doc(covered(hashes, w, BASE_WINDOW).astype(np.int64), w.first),
    }
    for n in COVERAGE:
        out[f"chars_{n}"] = per_doc(chars * covered(hashes, w, n), w.first)
    # Lines as written, between newlines; only those with a word count, and no empty run can have one.
    line = runs(chunk.data != 10, chunk.offsets)
    has = np.searchsorted(w.start, line.end) > np.searchsorted(w.start, line.start)
    ls, le, doc = line.start[has], line.end[has], line.doc[has]
    keys = mixed(run_hashes(prefix, ls, le) + doc.astype(U64) * U64(0xD6E8FEB86659FD93))
    order = np.argsort(keys, kind="stable")
    later = np.zeros(len(keys), bool)  # stable: the first of equal lines comes first
    later[order[1:]] = keys[order[1:]] == keys[order[:-1]]
    first = np.searchsorted(doc, np.arange(chunk.n + 1))
    count = np.zeros(len(w.start) + 1, np.int64)
    np.cumsum(chars, out=count[1:])
    line_chars = count[np.searchsorted(w.start, le)] - count[np.searchsorted(w.start, ls)]
    out["n_dup_lines"] = per_doc(later.astype(np.int64), first)
    out["chars_lines"] = per_doc(line_chars * _again(keys), first)
    return out


_OUT = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *(f"chars_{n}" for n in COVERAGE), "chars_lines"]


def repetition(docs: DataFrame) -> DataFrame:
    """doc_id and the counts of ``measures`` for every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            for chunk in chunks(batch.column("text")):
                got = measures(chunk)
                yield pa.record_batch([ids.slice(chunk.rows.start, chunk.n), *(pa.array(got[c].astype(np.int64)) for c in _OUT)], names=["doc_id", *_OUT])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in _OUT))


def judged(docs: DataFrame) -> DataFrame:
    """``repetition`` with the coverage shares, base_failed and kept."""
    share = lambda c: F.when(F.col("word_chars") > 0, F.col(c) / F.col("word_chars")).otherwise(F.lit(0.0))
    m = repetition(docs)
    m = m.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))
    m = m.withColumns({f"share_{n}": share(f"chars_{n}") for n in COVERAGE} | {"share_lines": share("chars_lines")})
    bad = F.col("share_lines") > LINE_COVERAGE
    for n, most in COVERAGE.items():
        bad = bad | (F.col(f"share_{n}") > most)
    return m.withColumn("kept", ~F.col("base_failed") & ~bad)


def op10_repetition_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = judged(documents(spark, sf_dir))
    base = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return m.select(*base, *(f"share_{n}" for n in COVERAGE), "share_lines")
