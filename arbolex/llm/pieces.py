"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies with byte fallback.

A text is prefixed with the space mark, its spaces become marks, and it is cut before each run of marks: no piece of the
vocabulary crosses such a cut, so each unit's pieces depend on the unit alone. A unit is merged by an agenda of its adjacent
symbol pairs: the pair whose joined piece has the best score is merged first, of equal ones the leftmost, and the merge puts
its two new pairs on the agenda. The units of a chunk that are not known yet are merged in lockstep in numpy, one merge a
unit and round; a long unit has a heap of its own, so that it takes n log n steps. What no piece covers becomes its bytes.

Every text is also encoded, and its ids decoded, by the sentencepiece library in the same Arrow batch. Where the two
differ the library's result stands and ``agrees`` is false (no text of the tests does). A vocabulary that this form cannot
express, as it gives other ids for a probe, is refused.

Defined cases: a null or empty text has no ids and decodes to ''; bytes that are no UTF-8 count as U+FFFD; the space mark
in a text is a space, as in the library; null ids decode as none; ids outside the vocabulary, or null, make the row's
decoding fail as in the library; equal and repeated rows are handled one by one; an empty table gives no rows. Other
columns stay; those of the results' names are replaced. Memory: a chunk of about 2 MB of whole texts, and at most
``CACHED`` short units beside those of the chunk.
"""

from __future__ import annotations

import gc
import heapq
import re
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, documents

MODEL = "piece_bpe_32k.model"
MARK = "▁"
LOCKSTEP = 32  # symbols; longer units have a heap, and are not remembered
CACHED = 500_000  # units a worker remembers, some 130 MB
_WIDTHS = (6, 8, 9, 10, 12, 16, 24, LOCKSTEP)
_WIDTH = [next(w for w in _WIDTHS if n <= w) for n in range(LOCKSTEP + 1)]
_UNIT = re.compile(f"{MARK}+[^{MARK}]*")
_NONE = np.iinfo(np.int32).max
_CODE_POINTS = 0x110000
_MIX = 0x9E3779B97F4A7C15
_IDS = 1 << 19  # ids decoded at a time, or one row's
_PROBE = "Hello  world, café ▁naïve\n\t  \U0001f600\u0000 1234567 aaaa" + " " * 9 + "end "


def _cut(text: str) -> list[str]:
    """The units of a text, without the mark that each begins with."""
    if not text:
        return []
    if text[0] != " " and "  " not in text and MARK not in text:
        return text.split(" ")
    return [u[1:] for u in _UNIT.findall(MARK + text.replace(" ", MARK))]


class Pieces:
    """A vocabulary: which pairs of symbols join to a piece, and how well it scores.

    Symbols are piece ids, and beyond them the code points that are no piece of their own."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        lib = self.library
        self.size = n = len(lib)
        plain = [i for i in range(n) if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) or lib.is_unused(i))]
        self.ids = {lib.id_to_piece(i): i for i in plain}
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in self.ids):
            raise ValueError("a piece of this vocabulary crosses words")
        self.bytes = [lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.base = n + _CODE_POINTS + 1
        known = set(chain.from_iterable(self.ids))
        symbol = {c: n + ord(c) for c in known} | self.ids
        self.char = np.arange(n, n + _CODE_POINTS, dtype=np.int32)  # by code point
        for c in known:
            self.char[ord(c)] = symbol[c]
        scores = {p: lib.get_score(i) for p, i in self.ids.items()}
        rank = {s: k for k, s in enumerate(sorted(set(scores.values()), reverse=True))}
        joins = [(symbol[p[:k]] * self.base + symbol[p[k:]], rank[scores[p]], i) for p, i in self.ids.items() for k in range(1, len(p)) if p[:k] in symbol and p[k:] in symbol]
        self._fill(joins)
        by_rank = sorted((rank[scores[p]], i) for p, i in self.ids.items())
        # Where no two pieces have one score, the rank tells the piece.
        self.by_rank = np.array([i for _, i in by_rank], np.int32) if len(rank) == len(by_rank) else None
        self.pairs = {k: (r, j) for k, r, j in joins}
        self.cache: dict[str, tuple[int, ...]] = {}
        surface = [lib.id_to_piece(i).replace(MARK, " ").encode() for i in range(n)]
        for i in range(n):
            if lib.is_control(i):
                surface[i] = b""
            elif lib.is_unknown(i):
                surface[i] = " ⁇ ".encode()
        for b, i in enumerate(self.bytes):
            if lib.is_byte(i):
                surface[i] = bytes([b])
        self.surface = surface
        self.raw = frozenset(i for i in range(n) if lib.is_byte(i))
        if self.encode([_PROBE])[0] != lib.encode(_PROBE):
            raise ValueError("the vocabulary is not of the merge type with plain marks for spaces")

    def _symbols(self, text: str) -> np.ndarray:
        return self.char[np.frombuffer(text.encode("utf-32-le"), np.uint32)]

    def _fill(self, joins: list[tuple[int, int, int]]) -> None:
        """Pairs by hash, in a table so wide that most are found, or found missing, at the first look."""
        bits = max(10, (8 * len(joins)).bit_length())
        self._shift, self._mask = np.uint64(64 - bits), (1 << bits) - 1
        self._keys, self._ranks, self._joined = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32), np.zeros(1 << bits, np.int32)
        for key, rank, piece in joins:
            at = (key * _MIX & 0xFFFFFFFFFFFFFFFF) >> 64 - bits
            while self._keys[at] >= 0:
                at = at + 1 & self._mask
            self._keys[at], self._ranks[at], self._joined[at] = key, rank, piece

    def _slots(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Where pairs of symbols are in the table, -1 for none."""
        key = (left.astype(np.int64) * self.base + right).ravel()
        at = (key.view(np.uint64) * np.uint64(_MIX) >> self._shift).view(np.int64)
        there = self._keys[at]
        at[there == -1] = -1
        late = np.flatnonzero((there != key) & (at >= 0))
        while len(late):  # others of the same hash lie behind it
            at[late] = at[late] + 1 & self._mask
            there = self._keys[at[late]]
            empty = there == -1
            differs = there != key[late]
            at[late[empty]] = -1
            late = late[differs & ~empty]
        return at.reshape(left.shape)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the piece that two symbols join to, or _NONE."""
        at = self._slots(left, right)
        return np.where(at >= 0, self._ranks[at], _NONE)

    def _joint(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """The piece that two symbols join to, whose rank is known."""
        return self.by_rank[rank] if self.by_rank is not None else self._joined[self._slots(left, right)]

    def _lockstep(self, units: list[str], width: int) -> list[tuple[int, ...]]:
        """The agenda of many short units at once: each round merges every unit's best pair."""
        n, sizes = len(units), np.fromiter(map(len, units), np.int64, len(units)) + 1
        sym = np.full((n, width + 1), -1, np.int32)  # the last column stays empty
        sym[np.arange(width + 1) < sizes[:, None]] = self._symbols(MARK + MARK.join(units))
        rank = self._rank(sym[:, :-1], sym[:, 1:])
        alive, out, places = np.arange(n), [None] * n, np.arange(width + 1)
        while True:
            at = rank.argmin(axis=1)  # the first of equal ones
            best = rank[np.arange(len(alive)), at]
            over = best == _NONE
            done = sym[over]
            for k, row, size, odd in zip(alive[over].tolist(), done.tolist(), (done >= 0).sum(axis=1).tolist(), (done >= self.size).any(axis=1).tolist()):
                out[k] = self._as_ids(row[:size]) if odd else tuple(row[:size])
            if over.all():
                return out
            go = ~over
            alive, sym, rank, at, best = alive[go], sym[go], rank[go], at[go], best[go]
            line = np.arange(len(alive))
            sym[line, at] = self._joint(sym[line, at], sym[line, at + 1], best)
            # What stands behind the merged pair moves up by one; only the pairs beside it have new ranks.
            behind = places > at[:, None]
            sym[:, :-1] = np.where(behind[:, :-1], sym[:, 1:], sym[:, :-1])
            sym[:, -1] = -1
            rank[:, :-1] = np.where(behind[:, :-2], rank[:, 1:], rank[:, :-1])
            rank[:, -1] = _NONE
            rank[line, at] = self._rank(sym[line, at], sym[line, at + 1])
            left = np.maximum(at - 1, 0)
            rank[line, left] = self._rank(sym[line, left], sym[line, left + 1])

    def _heap(self, sym: list[int]) -> list[int]:
        """The agenda of one long unit."""
        n, pairs, base = len(sym), self.pairs, self.base
        after, before, agenda = list(range(1, n + 1)), list(range(-1, n - 1)), []

        def add(left: int, right: int) -> None:
            if left >= 0 and right < n and (found := pairs.get(sym[left] * base + sym[right])):
                agenda.append((found[0], left, sym[left], sym[right], found[1]))

        for k in range(n - 1):
            add(k, k + 1)
        heapq.heapify(agenda)
        waiting, agenda = agenda, []
        while waiting:
            _, left, a, b, piece = heapq.heappop(waiting)
            right = after[left]
            if sym[left] != a or right >= n or sym[right] != b:
                continue  # one of the two has been merged since
            sym[left], sym[right] = piece, -1
            after[left] = after[right]
            if after[left] < n:
                before[after[left]] = left
            add(before[left], left)
            add(left, after[left])
            while agenda:
                heapq.heappush(waiting, agenda.pop())
        return [s for s in sym if s >= 0]

    def _as_ids(self, symbols: list[int]) -> tuple[int, ...]:
        return tuple(i for s in symbols for i in ((s,) if s < self.size else (self.bytes[b] for b in chr(s - self.size).encode())))

    def units(self, units: set[str]) -> dict[str, tuple[int, ...]]:
        """The ids of distinct units, which are given without their first mark."""
        out: dict[str, tuple[int, ...]] = {}
        short: dict[int, list[str]] = {w: [] for w in _WIDTHS}
        for u in units:
            if len(u) >= LOCKSTEP:
                out[u] = self._as_ids(self._heap(self._symbols(MARK + u).tolist()))
            else:
                short[_WIDTH[len(u) + 1]].append(u)
        for width, us in short.items():
            if us:
                out.update(zip(us, self._lockstep(us, width)))
        return out

    def encode(self, texts: list[str]) -> list[list[int]]:
        texts = list(map(_cut, texts))
        known = self.cache
        new = set(chain.from_iterable(texts)).difference(known)
        known.update(self.units(new))
        out = [list(chain.from_iterable(map(known.__getitem__, t))) for t in texts]
        if len(known) > CACHED:
            known.clear()
        for u in new:
            if len(u) >= LOCKSTEP:
                known.pop(u, None)
        return out

    def decode(self, ids: list[int]) -> str:
        """Pieces end to end; the space that the first one may begin with goes, and bytes that are no UTF-8 each count as
        U+FFFD."""
        data = b"".join(map(self.surface.__getitem__, ids))
        if ids and ids[0] not in self.raw and data[:1] == b" " and not self.library.is_unknown(ids[0]):
            data = data[1:]
        try:
            return data.decode()
        except UnicodeDecodeError:
            return data.decode("utf-8", "surrogateescape").translate(_BROKEN)


_BROKEN = dict.fromkeys(range(0xDC80, 0xDD00), "�")


@lru_cache(maxsize=2)
def _pieces(model: bytes) -> Pieces:
    return Pieces(model)


def default_model() -> bytes:
    """The public vocabulary's file, half a MB; tasks get its bytes."""
    import public_tokenizers

    with open(public_tokenizers.path(MODEL), "rb") as f:
        return f.read()


def _with(batch: pa.RecordBatch, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    keep = {n: batch.column(n) for n in batch.schema.names if n not in columns}
    return pa.record_batch(keep | columns)


def _schema(df: DataFrame, fields: list[T.StructField]) -> T.StructType:
    names = {f.name for f in fields}
    return T.StructType([f for f in df.schema.fields if f.name not in names] + fields)


@contextmanager
def _uncollected() -> Iterator[None]:
    """Without searches for cycles, which the many small tuples here would set off, and of which there are none."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


def _array(lists: list[list[int]]) -> pa.Array:
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    flat = np.fromiter(chain.from_iterable(lists), np.int32, int(sizes.sum()))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(flat))


def tokenized(docs: DataFrame, model: bytes | None = None, text: str = "text", decode: bool = False) -> DataFrame:
    """``docs`` with the columns ids (array<int>) and agrees (boolean): the pieces of each whole text. With ``decode`` also
    decoded (string), the text that the ids stand for, and agrees tells of both ways."""
    model = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(model)
        for batch in batches:
            for chunk in chunks(batch.column(text)):
                with _uncollected():
                    texts = [chunk.text(k).decode("utf-8", "replace") for k in range(chunk.n)]
                    library = pieces.library.encode(texts, num_threads=1)
                    agrees = [a == b for a, b in zip(pieces.encode(texts), library)]
                    columns = {"ids": _array(library)}
                    if decode:
                        back = pieces.library.decode(library) if library else []
                        agrees = [a and pieces.decode(i) == b for a, i, b in zip(agrees, library, back)]
                        columns["decoded"] = pa.array(back, pa.string())
                yield _with(batch.slice(chunk.rows.start, chunk.n), columns | {"agrees": pa.array(agrees, pa.bool_())})

    fields = [T.StructField("ids", T.ArrayType(T.IntegerType())), *([T.StructField("decoded", T.StringType())] if decode else []), T.StructField("agrees", T.BooleanType())]
    return docs.mapInArrow(run, _schema(docs, fields))


def detokenized(rows: DataFrame, model: bytes | None = None, ids: str = "ids") -> DataFrame:
    """``rows`` with the columns decoded (string) and agrees (boolean): the text that each row's ids stand for."""
    model = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(model)
        for batch in batches:
            ends = np.cumsum(pc.fill_null(pc.list_value_length(batch.column(ids)), 0).to_numpy(zero_copy_only=False))
            lo = 0
            while lo < batch.num_rows:
                hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + _IDS, "right")))
                part = batch.slice(lo, hi - lo)
                given = [x or [] for x in part.column(ids).to_pylist()]
                library = pieces.library.decode(given)
                yield _with(part, {"decoded": pa.array(library, pa.string()), "agrees": pa.array([pieces.decode(x) == y for x, y in zip(given, library)], pa.bool_())})
                lo = hi

    return rows.mapInArrow(run, _schema(rows, [T.StructField("decoded", T.StringType()), T.StructField("agrees", T.BooleanType())]))


def op11_score_agenda(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tokenized(documents(spark, sf_dir).select("doc_id", "text"), decode=True)
    digest = lambda x: F.sha2(x.cast("binary"), 256)
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest(F.array_join(F.col("ids").cast("array<string>"), ",")).alias("ids_sha256"), digest(F.col("decoded")).alias("decoded_sha256"), "agrees")
