"""Substring dedup by words with suffix automata.

The corpus is its own reference. Its shards are made by content (see ``fragments``): one shard holds all passages that
share an anchor, and some thousand anchors. Passages of documents are routed to the shard that can hold their windows;
broadcasting the automata of all shards would send the whole corpus everywhere. In a shard, passages are taken in corpus
order. Each is streamed through the shard's automaton for its matching statistics; where these reach the window length,
the window is a repeat and what it covers is removed. Then the passage is added to the automaton. The later places of an
equal passage are streamed through the automaton that holds it.

Defined cases: a null or blank text has no words; a text shorter than the window keeps all; equal windows of one text
are repeats of the first; an empty table gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .common import Chunk, documents, word_hashes, words
from .fragments import REPEAT, Kind, deduplicated

WINDOW, GRAM = 20, 5
SHARD_BYTES = 192 << 10  # passages in one automaton, which takes some 60 bytes for each of them


class Automaton:
    """Suffix automaton of several passages."""

    def __init__(self) -> None:
        self.next: list[dict[bytes, int]] = [{}]
        self.link = [-1]
        self.length = [0]

    def _state(self, length: int, link: int, after: dict[bytes, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(after)
        return len(self.next) - 1

    def _split(self, p: int, word: bytes) -> int:
        """The state after ``p`` and ``word`` whose longest string is one longer than that of p."""
        nxt, link, length = self.next, self.link, self.length
        q = nxt[p][word]
        if length[q] == length[p] + 1:
            return q
        clone = self._state(length[p] + 1, link[q], dict(nxt[q]))
        link[q] = clone
        while p >= 0 and nxt[p].get(word) == q:
            nxt[p][word] = clone
            p = link[p]
        return clone

    def add(self, passage: list[bytes]) -> None:
        nxt, link, length = self.next, self.link, self.length
        last = 0
        for word in passage:
            if word in nxt[last]:
                last = self._split(last, word)
                continue
            cur = self._state(length[last] + 1, 0, {})
            p = last
            while p >= 0 and word not in nxt[p]:
                nxt[p][word] = cur
                p = link[p]
            if p >= 0:
                link[cur] = self._split(p, word)
            last = cur

    def matching(self, passage: list[bytes]) -> list[int]:
        """For each word, the length of the longest suffix up to it that is in some passage added before."""
        nxt, link, length = self.next, self.link, self.length
        state = matched = 0
        out = []
        for word in passage:
            while state and word not in nxt[state]:
                state = link[state]
                matched = length[state]
            to = nxt[state].get(word)
            if to is not None:
                state, matched = to, matched + 1
            out.append(matched)
        return out


def _values(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    w = words(chunk)
    return word_hashes(chunk, w), w.first


def _cutter(text: bytes):
    split = text.split()
    return lambda start, n: b" ".join(split[start : start + n])


def _finish(text: bytes, gone: np.ndarray) -> tuple:
    split = text.split()  # at the same six bytes as the words' pattern
    n = len(split)
    if len(gone):
        keep = np.ones(n, bool)
        for lo, hi in gone.tolist():
            keep[lo:hi] = False
        split = list(compress(split, keep.tolist()))
    return n, n - len(split), hashlib.sha256(b" ".join(split)).hexdigest()


def _runs(stats: list[int], window: int) -> list[tuple[int, int]]:
    """(first, windows) of the runs of windows that matching statistics reach."""
    out, first = [], None
    for i, n in enumerate(stats):
        if n >= window:
            if first is None:
                first = i - window + 1
        elif first is not None:
            out.append((first, i - window + 1 - first))
            first = None
    if first is not None:
        out.append((first, len(stats) - window + 1 - first))
    return out


def _decide(contents: list[bytes], whole: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Passages of one reference shard, in corpus order: which of their windows the automaton holds before they are
    added, and, of those wanted whole, which it holds after that."""
    automaton = Automaton()
    first: list[tuple[int, int, int]] = []
    later: list[tuple[int, int, int]] = []
    for k, (raw, wanted) in enumerate(zip(contents, whole.tolist())):
        passage = raw.split(b" ")
        told = _runs(automaton.matching(passage), window)
        first += [(k, *run) for run in told]
        if told != [(0, len(passage) - window + 1)]:  # else all of its windows are there
            automaton.add(passage)
        if wanted:
            later += [(k, *run) for run in _runs(automaton.matching(passage), window)]
    return np.array(first, REPEAT), np.array(later, REPEAT)


KIND = Kind(WINDOW, GRAM, _values, _cutter, _finish, _decide, "n_words long, n_removed long, kept_sha256 string", 7, SHARD_BYTES)


def passage_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for every document."""
    return deduplicated(docs, KIND)


def op2_suffix_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passage_dedup(documents(spark, sf_dir))
