"""Substring dedup by bytes with external induced sorting.

The corpus is cut into shards by content (see ``fragments``); the unlike fragments of one anchor are all in one shard.
A shard's fragments, end to end with separators, are written to a scratch file and sorted by induction:

* suffixes are of type S or L (smaller or larger than the next one); leftmost S ones (LMS) are the seeds;
* the seeds are sorted by names: their LMS substrings are named in ranges of their first symbols, and names are sorted by
  pairs, pairs of pairs and so on until they span more than a window, so that what is not told apart by then is equal in a
  window;
* one scan upwards induces the L suffixes from the seeds, one downwards the S suffixes from those. Between them stands a
  priority queue of tuples (suffix, common prefix with the tuple before it), one bucket for each first symbol. Tuples
  arrive in order, so a bucket is a plain file; buckets beyond the memory limit are appended to a scratch file, from which
  they are taken a batch at a time.

The common-prefix value of an induced tuple is one more than the minimum over what was scanned since the last tuple of
its bucket. In the second scan suffixes that share a window's length come next to each other; of each such class the
earliest in the corpus stays, the others are repeats. All work is done in batches in numpy.

Text, types, seeds, names, the upper half of the suffixes and the queue lie in scratch files; in memory are one batch, one
range of names, MEMORY bytes of the queue and one class of equal windows, whatever the shard. Scratch files live inside one
task attempt, have no name, and are gone with it; nothing else reads them.

Defined cases: a null text is empty; a text shorter than the window keeps all; equal windows of one text are repeats of
the first; an empty table gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import mmap
import tempfile
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .common import BYTE_VALUES, Chunk, documents
from .fragments import REPEAT, Kind, deduplicated

WINDOW, GRAM = 100, 40
SHARD_BYTES = 2 << 20  # contents of one sort, about; its scratch files take some 14 bytes for each of them
SYMBOLS = 257  # 0 separates, byte b is b + 1
CAP = WINDOW + 4  # common prefixes are counted up to here
MEMORY = 1 << 19  # of the queue
BATCH = 1 << 16  # suffixes, or symbols, handled at a time
RANGE = 1 << 17  # seeds that are named or sorted at a time, or one group of equal names
TUPLE = np.dtype([("at", "<i4"), ("lcp", "u1")])


def scratch(n: int, kind: np.dtype | str) -> np.ndarray:
    """``n`` zeros in a file without a name."""
    if not n:
        return np.zeros(0, kind)
    with tempfile.TemporaryFile() as f:
        f.truncate(n * np.dtype(kind).itemsize)
        return np.frombuffer(mmap.mmap(f.fileno(), 0), kind)  # writes go to the file


class DiskQueue:
    """A monotone priority queue: one bucket of tuples for each symbol, each in order of arrival. Beyond ``memory`` bytes
    the held tuples go to a scratch file."""

    def __init__(self, buckets: int = SYMBOLS, memory: int = MEMORY):
        self.held: list[list[np.ndarray]] = [[] for _ in range(buckets)]
        self.spilled: list[list[tuple[int, int]]] = [[] for _ in range(buckets)]
        self.memory, self.size, self.file, self.spills = memory, 0, None, 0

    def put(self, bucket: int, tuples: np.ndarray) -> None:
        self.held[bucket].append(tuples)
        self.size += tuples.nbytes
        if self.size > self.memory:
            self._spill()

    def _spill(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        self.file.seek(0, 2)
        for bucket, parts in enumerate(self.held):
            if parts:
                data = np.concatenate(parts)
                self.spilled[bucket].append((self.file.tell(), len(data)))
                self.file.write(data.tobytes())
                parts.clear()
        self.spills += 1
        self.size = 0

    def take(self, bucket: int) -> np.ndarray:
        """The next tuples of a bucket in order of arrival, BATCH at most, and none once it is empty."""
        most = BATCH
        if self.spilled[bucket]:
            at, n = self.spilled[bucket][0]
            now = min(n, most)
            self.file.seek(at)
            got = np.frombuffer(self.file.read(now * TUPLE.itemsize), TUPLE)
            self.spilled[bucket][:1] = [(at + now * TUPLE.itemsize, n - now)] if now < n else []
            return got
        if not self.held[bucket]:
            return np.zeros(0, TUPLE)
        got = self.held[bucket].pop(0)
        if len(got) > most:
            self.held[bucket].insert(0, got[most:])
            got = got[:most]
        elif len(got) < most // 4 and self.held[bucket]:  # many small ones at once
            few = [got]
            while self.held[bucket] and sum(map(len, few)) + len(self.held[bucket][0]) <= most:
                few.append(self.held[bucket].pop(0))
            got = np.concatenate(few)
        self.size -= got.nbytes
        return got

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


def is_s_type(text: np.ndarray) -> np.ndarray:
    """Which suffixes are smaller than the next one; the last is not. From the end, a batch at a time."""
    n, batch = len(text), BATCH
    out = scratch(n, bool)
    after = False  # of the suffix at the batch's end
    for lo in range((n - 2) // batch * batch if n > 1 else 0, -1, -batch):
        part = np.asarray(text[lo : lo + batch + 1]).astype(np.int16)
        step = np.sign(np.diff(part))  # 1: smaller than the next symbol
        if not len(step):
            continue
        where = np.where(step != 0, np.arange(len(step)), len(step))
        nearest = np.minimum.accumulate(where[::-1])[::-1]
        out[lo : lo + len(step)] = np.where(nearest < len(step), step[np.minimum(nearest, len(step) - 1)] > 0, after)
        after = bool(out[lo])
    return out


def leftmost(s_type: np.ndarray) -> np.ndarray:
    """Places of the leftmost S suffixes, in order."""
    n, batch = len(s_type), BATCH
    each = [np.flatnonzero(s_type[lo + 1 : lo + batch + 1] & ~s_type[lo : lo + batch][: len(s_type[lo + 1 : lo + batch + 1])]) for lo in range(0, max(0, n - 1), batch)]
    out, at = scratch(sum(map(len, each)), "<i4"), 0
    for k, x in enumerate(each):
        out[at : at + len(x)] = x + k * batch + 1
        at += len(x)
        each[k] = x[:0]
    return out


def padded(contents: np.ndarray) -> np.ndarray:
    """Symbols with zeros after them, so that quads may reach past the end."""
    out = scratch(len(contents) + CAP + 8, "<u2")
    out[: len(contents)] = contents
    return out


def _quads(text: np.ndarray) -> np.ndarray:
    """At each place of a padded text the next four symbols as one number, the first lowest; past the end are zeros."""
    return np.ndarray((len(text) - 4,), "<u8", text, strides=(2,))


def common_prefixes(quads: np.ndarray, a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Common prefixes of the suffixes at a and b, up to CAP and to the end of the text."""
    out = np.minimum(np.minimum(n - a, n - b), CAP)
    todo = np.arange(len(a))
    for off in range(0, CAP, 4):
        if not len(todo):
            break
        x = quads[a[todo] + off] ^ quads[b[todo] + off]
        more = (x & 0xFFFF == 0).astype(np.int64) + (x & 0xFFFFFFFF == 0) + (x & 0xFFFFFFFFFFFF == 0)
        differ = x != 0
        end = todo[differ]
        out[end] = np.minimum(out[end], off + more[differ])
        todo = todo[~differ & (off + 4 < out[todo])]
    return out


def _dense(keys: np.ndarray) -> np.ndarray:
    """Ranks of keys, equal for equal ones, from 1."""
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    step = np.ones(len(s), np.int64)
    step[1:] = s[1:] != s[:-1]
    out = np.empty(len(s), np.int64)
    out[order] = np.cumsum(step)
    return out


def _names(text: np.ndarray, at: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Dense names from 1 of LMS substrings, in their order. text is padded.

    A name spans the symbols up to the next LMS place and its own. A substring that ends there is the larger of two that
    agree so far, since the other goes on with an L suffix of the same symbol; so it is filled up with a top value."""
    rank = np.ones(len(at), np.int64)
    live = np.arange(len(at))
    off = 0
    while len(live):
        key = np.zeros(len(live), np.int64)
        for j in range(off, off + 6):
            symbol = text[np.minimum(at[live] + j, len(text) - 1)].astype(np.int64) + (at[live] + j < len(text) - CAP - 8)
            key = key * 512 + np.where(j < length[live], symbol, 511)
        group = rank[live]
        order = np.lexsort((key, group))
        group, key = group[order], key[order]
        lead = np.ones(len(live), bool)
        lead[1:] = group[1:] != group[:-1]
        step = lead.copy()
        step[1:] |= key[1:] != key[:-1]
        # Inside an old rank, new ranks count up from it; ranks leave gaps as wide as their groups.
        place = np.arange(len(live))
        head = np.maximum.accumulate(np.where(step, place, 0))
        base = np.maximum.accumulate(np.where(lead, place, 0))
        out = np.empty(len(live), np.int64)
        out[order] = group + (head - base)
        rank[live] = out
        size = np.diff(np.append(np.flatnonzero(step), len(live)))
        tied = np.empty(len(live), bool)
        tied[order] = np.repeat(size > 1, size)
        off += 6
        live = live[tied & (length[live] > off)]
    return _dense(rank)


def _tied_ranges(rank: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Cuts sorted ranks into ranges of about ``most`` that part no equal ones."""
    lo, n = 0, len(rank)
    while lo < n:
        hi = min(n, lo + most)
        while hi < n and rank[hi] == rank[hi - 1]:  # on to the end of the group, a batch at a time
            same = rank[hi : hi + BATCH] == rank[hi - 1]
            hi += int(same.argmin()) if not same.all() else len(same)
        yield lo, hi
        lo = hi


def sorted_seeds(text: np.ndarray, lms: np.ndarray, depth: int, n: int) -> np.ndarray:
    """The LMS suffixes of a padded text of ``n`` symbols in order of at least their first ``depth`` symbols."""
    m, most = len(lms), RANGE
    if m < 2:
        return lms
    # Ranges of the first two symbols, each of about ``most`` seeds, named one after the other.
    first = scratch(m, "<i4")
    tally = np.zeros(SYMBOLS * SYMBOLS, np.int64)
    for lo in range(0, m, BATCH):
        p = np.asarray(lms[lo : lo + BATCH])
        first[lo : lo + BATCH] = text[p].astype(np.int32) * SYMBOLS + text[p + 1]
        tally += np.bincount(first[lo : lo + BATCH], minlength=len(tally))
    total = np.cumsum(tally)
    edges = [0]
    while edges[-1] < len(tally):
        done = int(total[edges[-1] - 1]) if edges[-1] else 0
        edges.append(max(edges[-1] + 1, int(np.searchsorted(total, done + most, "right"))))
    sorted_, rank, ordered = scratch(m, "<i4"), scratch(m + 1, "<i4"), scratch(m, "<i4")
    at = 0
    for x, y in zip(edges[:-1], edges[1:]):
        mine = [np.flatnonzero((first[lo : lo + BATCH] >= x) & (first[lo : lo + BATCH] < y)) + lo for lo in range(0, m, BATCH)] if total[y - 1] > (total[x - 1] if x else 0) else []
        k = np.concatenate(mine) if mine else np.zeros(0, np.int64)
        if not len(k):
            continue
        p = lms[k].astype(np.int64)
        # The last one ends with the end of the text, which is below all symbols.
        end = np.where(k + 1 < m, lms[np.minimum(k + 1, m - 1)], n)
        r = _names(text, p, end - p + 1)
        order = np.argsort(r, kind="stable")
        r = r[order]
        head = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
        r = np.repeat(head + at, np.diff(np.append(head, len(r)))) + 1
        rank[k[order]] = r
        sorted_[at : at + len(k)], ordered[at : at + len(k)] = k[order], r
        at += len(k)
    # Pairs of names, then pairs of pairs: each spans two symbols at least. A rank is the place of the first of its equals,
    # from 1, so those without equals are done; past the last seed stands rank 0.
    width, tied = 1, True
    while width * 2 < 2 * depth and tied:
        tied = False
        for lo, hi in _tied_ranges(ordered, most):
            own = ordered[lo:hi]
            same = np.zeros(hi - lo, bool)
            same[1:] = own[1:] == own[:-1]
            same[:-1] |= same[1:]
            live = np.flatnonzero(same)
            if not len(live):
                continue
            own = own[live].astype(np.int64)
            k = sorted_[lo + live].astype(np.int64)
            key = own * (m + 2) + rank[np.minimum(k + width, m)]
            order = np.argsort(key, kind="stable")
            k, key, own = k[order], key[order], own[order]
            step = np.concatenate([[True], key[1:] != key[:-1]])
            lead = np.concatenate([[True], own[1:] != own[:-1]])
            place = np.arange(len(k))
            new = own + np.maximum.accumulate(np.where(step, place, 0)) - np.maximum.accumulate(np.where(lead, place, 0))
            sorted_[lo + live], ordered[lo + live] = k, new
            rank[k] = new
            tied |= not step.all()
        width *= 2
    for lo in range(0, m, BATCH):
        sorted_[lo : lo + BATCH] = lms[sorted_[lo : lo + BATCH]]
    return sorted_


class _Minima:
    """Range minima over one batch by a table of powers of two."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        step = 1
        while 2 * step <= len(values):
            last = self.levels[-1]
            self.levels.append(np.minimum(last[:-step], last[step:]))
            step *= 2

    def between(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Minimum of values[lo..hi], hi included, lo <= hi."""
        size = hi - lo + 1
        level = np.frexp(size.astype(np.float64))[1] - 1
        out = np.empty(len(lo), np.uint8)
        for k in np.unique(level):
            m = level == k
            row = self.levels[k]
            out[m] = np.minimum(row[lo[m]], row[hi[m] - (1 << int(k)) + 1])
        return out


class _Scan:
    """One scan over sorted suffixes that induces their predecessors, those of the wanted type, into a queue."""

    def __init__(self, text: np.ndarray, s_type: np.ndarray, wanted: bool, memory: int):
        self.text, self.s_type, self.wanted = text, s_type, wanted
        self.queue = DiskQueue(memory=memory)
        # Minimum of the common prefixes scanned since the last tuple of each bucket; none came before the first.
        self.since = np.zeros(SYMBOLS, np.uint8)

    def seed(self, at: int) -> None:
        self.queue.put(int(self.text[at]), np.array([(at, 0)], TUPLE))

    def feed(self, batch: np.ndarray) -> None:
        """batch: the next suffixes of the scan, each with its common prefix with the one scanned before it."""
        if not len(batch):
            return
        lcp = batch["lcp"]
        before = batch["at"] - 1
        k = np.flatnonzero((before >= 0) & (self.s_type[np.maximum(before, 0)] == self.wanted))
        symbol = self.text[before[k]]
        order = np.argsort(symbol, kind="stable")
        k, symbol = k[order], symbol[order]
        lead = np.ones(len(k), bool)
        lead[1:] = symbol[1:] != symbol[:-1]
        first = np.flatnonzero(lead)
        out = np.empty(len(k), TUPLE)
        out["at"] = before[k]
        got = np.zeros(len(k), np.uint8)
        ahead = np.minimum.accumulate(lcp)
        rest = np.flatnonzero(~lead)
        if len(rest):
            got[rest] = _Minima(lcp).between(k[rest - 1] + 1, k[rest])
        got[first] = np.minimum(self.since[symbol[first]], ahead[k[first]])
        out["lcp"] = np.minimum(got, CAP - 1) + 1
        # What is left of the batch after each bucket's last tuple.
        behind = np.full(len(lcp) + 1, 255, np.uint8)
        behind[:-1] = np.minimum.accumulate(lcp[::-1])[::-1]
        self.since = np.minimum(self.since, ahead[-1])
        ends = np.append(first[1:], len(k))
        for lo, hi in zip(first.tolist(), ends.tolist()):
            s = int(symbol[lo])
            self.queue.put(s, out[lo:hi])
            self.since[s] = behind[k[hi - 1] + 1]


class Suffixes:
    """The suffixes of a text (symbols below SYMBOLS), sorted by at least their first ``depth`` symbols; those that share so
    many stand together in any order."""

    def __init__(self, text: np.ndarray, depth: int = WINDOW, memory: int = MEMORY):
        self.n, self.depth, self.memory = len(text), depth, memory
        self.padded = padded(text)
        self.text = self.padded[: self.n]
        self.quads = _quads(self.padded)
        self.spills = 0

    def _joint(self, a: int, b: int) -> int:
        return int(common_prefixes(self.quads, np.array([a]), np.array([b]), self.n)[0])

    def downwards(self) -> Iterator[np.ndarray]:
        """Batches of tuples from the largest suffix to the smallest, each with its common prefix with the one before it
        in this order; up to CAP these are exact below the depth."""
        n = self.n
        if n < 2:
            yield np.array([(k, 0) for k in range(n)], TUPLE)
            return
        s_type = is_s_type(self.text)
        lms = leftmost(s_type)
        seeds = sorted_seeds(self.padded, lms, self.depth, n)
        del lms
        first = np.concatenate([[0], np.cumsum(self._tally(seeds))])
        # Upwards: of each bucket the L suffixes, while they induce more of their own bucket, then the seeds.
        up = _Scan(self.text, s_type, False, self.memory)
        up.seed(n - 1)
        large, ends, at = scratch(n, TUPLE), [0], 0
        for c in range(SYMBOLS):
            began = at
            while len(batch := up.queue.take(c)):
                if at == began:
                    batch = batch.copy()
                    batch["lcp"][0] = 0  # the first of its bucket
                large[at : at + len(batch)] = batch
                at += len(batch)
                up.feed(batch)
            ends.append(at)
            for lo in range(first[c], first[c + 1], BATCH):
                p = np.asarray(seeds[lo : min(lo + BATCH, first[c + 1])])
                mine = np.zeros(len(p), TUPLE)
                mine["at"] = p
                p = p.astype(np.int64)
                mine["lcp"][1:] = common_prefixes(self.quads, p[:-1], p[1:], n)
                before = int(seeds[lo - 1]) if lo > first[c] else int(large[at - 1]["at"]) if at > began else None
                mine["lcp"][0] = 0 if before is None else self._joint(before, int(p[0]))
                up.feed(mine)
        self.spills += up.queue.spills
        up.queue.close()
        # Downwards: of each bucket the S suffixes from the largest, then its L suffixes.
        down = _Scan(self.text, s_type, True, self.memory)
        for c in range(SYMBOLS - 1, -1, -1):
            last = None
            while len(batch := down.queue.take(c)):
                if last is None:
                    batch = batch.copy()
                    batch["lcp"][0] = 0
                last = int(batch["at"][-1])
                yield batch
                down.feed(batch)
            for hi in range(ends[c + 1], ends[c], -BATCH):
                lo = max(ends[c], hi - BATCH)
                big = np.asarray(large[lo:hi])
                back = np.zeros(len(big), TUPLE)
                back["at"] = big["at"][::-1]
                back["lcp"][1:] = big["lcp"][:0:-1]
                if hi < ends[c + 1]:
                    back["lcp"][0] = large[hi]["lcp"]
                elif last is not None:
                    back["lcp"][0] = self._joint(int(back["at"][0]), last)
                yield back
                down.feed(back)
        self.spills += down.queue.spills
        down.queue.close()

    def _tally(self, seeds: np.ndarray) -> np.ndarray:
        out = np.zeros(SYMBOLS, np.int64)
        for lo in range(0, len(seeds), BATCH):
            out += np.bincount(self.text[seeds[lo : lo + BATCH]], minlength=SYMBOLS)
        return out


def induced_sort(text: np.ndarray, depth: int = WINDOW, memory: int = MEMORY) -> tuple[np.ndarray, np.ndarray]:
    """All suffixes upwards, and the common prefix of each with the one before it, in memory."""
    all_ = np.concatenate([np.zeros(0, TUPLE), *Suffixes(text, depth, memory).downwards()])
    lcp = np.zeros(len(all_), np.uint8)
    lcp[1:] = all_["lcp"][:0:-1]
    return all_["at"][::-1], lcp


def classes(suffixes: Suffixes, window: int) -> Iterator[np.ndarray]:
    """Places of the suffixes, a batch at a time, in whole classes, with the number of their class: those of one class
    share ``window`` symbols or more."""
    held, number = np.zeros((0, 2), np.int64), 0
    for batch in suffixes.downwards():
        label = np.cumsum(batch["lcp"] < window) + number
        number = int(label[-1])
        held = np.concatenate([held, np.stack([batch["at"].astype(np.int64), label], 1)])
        whole = int(np.searchsorted(held[:, 1], number))
        if whole:
            yield held[:whole]
            held = held[whole:]
    if len(held):
        yield held


def _decide(contents: list[bytes], whole: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Fragments of one shard, in corpus order: which of their windows stand beside an equal one of an earlier fragment
    among the sorted suffixes, and, of those wanted whole, which stand beside one of an earlier fragment or themselves."""
    size = np.fromiter(map(len, contents), np.int64, len(contents))
    first = np.cumsum(size + 1) - size - 1
    n = int((size + 1).sum())
    text, at = scratch(n, "<u2"), 0
    for lo in range(0, len(contents), 1024):
        part = np.frombuffer(b"\0".join(contents[lo : lo + 1024]) + b"\0", np.uint8)
        text[at : at + len(part)] = part
        text[at : at + len(part)] += 1
        at += len(part)
    text[first + size] = 0
    earlier, held = scratch(n, bool), scratch(n, bool)
    for group in classes(Suffixes(text, window), window):
        at, label = group[:, 0], group[:, 1] - group[0, 1]
        of = np.searchsorted(first, at, "right") - 1
        full = at - first[of] <= size[of] - window
        at, label = at[full], label[full]
        # The first in the text is the earliest in the corpus, as fragments are in order.
        least = np.full(int(group[-1, 1] - group[0, 1]) + 1, n, np.int64)
        np.minimum.at(least, label, at)
        earlier[at[least[label] < at]] = True
        held[at[least[label] <= at]] = True
    return _windows(np.flatnonzero(earlier), first), _windows(np.flatnonzero(held), first, whole)


def _windows(at: np.ndarray, first: np.ndarray, whole: np.ndarray | None = None) -> np.ndarray:
    """Runs of windows at places of the text, of all fragments or of those in ``whole``."""
    of = np.searchsorted(first, at, "right") - 1
    if whole is not None:
        at, of = at[whole[of]], of[whole[of]]
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (of[1:] != of[:-1])
    lo = np.flatnonzero(new)
    out = np.zeros(len(lo), REPEAT)
    out["fragment"], out["first"], out["windows"] = of[lo], at[lo] - first[of[lo]], np.diff(np.append(lo, len(at)))
    return out


def _values(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    return BYTE_VALUES[chunk.data], chunk.offsets


def _cutter(text: bytes):
    return lambda start, n: text[start : start + n]


def _finish(text: bytes, gone: np.ndarray) -> tuple:
    digest, at, removed, spans = hashlib.sha256(), 0, 0, 0
    for lo, hi in gone.tolist():
        hi = min(hi, len(text))
        if lo >= hi:
            continue
        # Runs that touch are one.
        spans += not (spans and lo == at)
        digest.update(text[at:lo])
        removed += hi - lo
        at = hi
    digest.update(text[at:])
    return len(text), removed, spans, digest.hexdigest()


KIND = Kind(WINDOW, GRAM, _values, _cutter, _finish, _decide, "n_bytes long, n_removed long, n_spans long, kept_sha256 string", 1, SHARD_BYTES)


def byte_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every document."""
    return deduplicated(docs, KIND)


def op3_induced_sorting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_dedup(documents(spark, sf_dir))
