"""Benchmark decontamination by template canonicalisation.

A text becomes tokens (runs of letters and digits; a point or comma between digits belongs to the number). Numbers,
names (title-case words inside a sentence, and the same words at a sentence's start if the text also has them inside
one) and units (after a number) become typed placeholders; other words are lower-cased. Windows of WINDOW canonical
tokens are hash-joined with the benchmark's. Along each diagonal of matching windows, the values in the placeholders
must map consistently, one benchmark value to one document value, as they do when a question was re-parameterised. A
document is contaminated if consistent matches cover COVERAGE of an item's windows.

The benchmark is read in blocks of BLOCK_BYTES of text. Items that are the same template are merged first, in a block. An
item is looked into only when one of its rarest windows matches, as many of them as COVERAGE makes necessary; windows that
many items share therefore cost nothing, and nothing is lost. A benchmark of one block is broadcast, and documents are
decided where they are, without a shuffle. Of a larger one a bitmap of its rarest windows is broadcast, and the windows that it
lets through are joined with the table of these by a shuffle (``_many``): each text then meets the blocks that it shares
a window with, and one block at a time is in memory.

Windows of which more than half are placeholders say little, so templates leave them out. So that
names that the document's case shows otherwise than the item's are found too, every item is also matched by the plain
values of its tokens, where the templates have not found it: half of its windows of values make a hit.

Sums and equations are mostly numbers. An item that has no template of words, or fewer than MIN_TOKENS tokens, is read
once more with the marks + - * / = < > ^ % ( ) as literal tokens: "What is 17 + 25?" becomes ``what is NUMBER + NUMBER``, and matches the
same question with other numbers. An item that is too short even so, or has neither words nor marks enough for a template,
matches by its values, and below MIN_TOKENS tokens with marks only a line of its own, as in running text it would be chance.

Defined cases: null or empty texts are clean; items shorter than WINDOW tokens match as a whole; null items, and those
without a letter, digit or mark, match nothing; windows with fewer than half literal tokens
count by their values only; repeated rows are judged alike; empty tables give no rows or no matches; other columns, whatever their names, are kept or ignored.
"""

from __future__ import annotations

import pickle
import tempfile
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BYTE_VALUES, U64, Chunk, Words, checkpointed, chunks, documents, mixed, ngram_hashes, per_doc, prefix_sums, run_hashes, runs, work_path

WINDOW, MIN_TOKENS, COVERAGE, MAX_CONFLICTS = 8, 5, 0.5, 0.2
BLOCK_BYTES = 8 << 20
TRIGGER_BITS = 1 << 28  # 32 MB
UNITS = "mm cm m km in ft yd mi mg g kg t lb lbs oz ml l s sec min h hr hrs day days week weeks month months year years second seconds minute minutes hour hours meter meters metre metres kilometer kilometers mile miles foot feet inch inches gram grams kilogram kilograms liter liters litre litres percent dollar dollars euro euros cent cents degree degrees kmh mph kwh"
LITERAL, NUMBER, NAME, UNIT = range(4)
_MARKS = mixed(np.arange(1, 5, dtype=U64) * U64(0x632BE59BD9B4E019))

_B = np.arange(256)
_DIGIT = (_B >= 48) & (_B <= 57)
_UPPER = (_B >= 65) & (_B <= 90)
_LOWER = (_B >= 97) & (_B <= 122)
_INSIDE = _DIGIT | _UPPER | _LOWER | (_B >= 0x80)
_BREAK = ~_INSIDE & ~np.isin(_B, list(b" \t,'-"))
_MARK = np.isin(_B, list(b"+-*/=<>^%()"))
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32


@dataclass
class Tokens:
    start: np.ndarray  # in the chunk's bytes
    first: np.ndarray  # tokens of document k: first[k] to first[k + 1] - 1
    kind: np.ndarray
    value: np.ndarray  # hash of the lower-cased token
    canonical: np.ndarray


def _hash_words(text: str) -> np.ndarray:
    data = text.encode()
    chunk = Chunk(range(1), np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    w = runs(chunk.data != 32, chunk.offsets)
    return np.sort(run_hashes(prefix_sums(BYTE_VALUES[chunk.data]), w.start, w.end))


UNIT_HASHES = _hash_words(UNITS)


def _in(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are among the sorted known ones."""
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def canonical(chunk: Chunk, names: bool = True, marks: bool = False) -> Tokens:
    """Tokens of a chunk. A text mostly in capitals, or with a mark after most words, shows no names by its case; there,
    and without ``names``, they stay literal words. With ``marks`` those of arithmetic are tokens too."""
    data = chunk.data
    inside = _INSIDE[data]
    if len(data) > 2:
        digit = _DIGIT[data]
        inside[1:-1] |= np.isin(data[1:-1], (44, 46)) & digit[:-2] & digit[2:]
    w = runs(inside, chunk.offsets)
    if marks:
        at = np.flatnonzero(_MARK[data])
        start = np.sort(np.concatenate([w.start, at]))
        w = Words(start, np.sort(np.concatenate([w.end, at + 1])), np.searchsorted(start, chunk.offsets))
    folded = _LOW[data]
    latin = np.zeros(len(data), bool)  # capitals of the Latin-1 letters follow 0xC3
    latin[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
    folded[latin] += 32
    value = run_hashes(prefix_sums(BYTE_VALUES[folded]), w.start, w.end)

    def count(flags: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        total = np.zeros(len(data) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return total[hi] - total[lo]

    kind = np.zeros(len(w.start), np.int8)
    kind[count(_DIGIT[data], w.start, w.end) > 0] = NUMBER
    if len(kind):
        after = np.minimum(w.start + 1, len(data) - 1)
        capital = _UPPER[data[w.start]] | latin[after]
        small = _LOWER[data] | ((data >= 0x80) & ~latin & (data != 0xC3))
        title = capital & (count(small, w.start, w.end) > 0) & (kind == LITERAL)
        opens = np.ones(len(kind), bool)
        opens[1:] = count(_BREAK[data], w.end[:-1], w.start[1:]) > 0
        if marks:
            opens[1:] |= _MARK[data[w.start[:-1]]]
        opens[w.first[:-1][w.first[:-1] < len(kind)]] = True
        shout = capital & ~(count(small, w.start, w.end) > 0)
        blurred = (2 * per_doc(opens, w.first) > w.count) | (2 * per_doc(shout, w.first) > w.count)
        title &= ~blurred[w.doc] if names else False
        here = mixed(value + w.doc.astype(U64) * U64(0xD6E8FEB86659FD93))
        sure = np.unique(here[title & ~opens])
        kind[title & (~opens | _in(here, sure))] = NAME
        unit = np.zeros(len(kind), bool)
        unit[1:] = (kind[:-1] == NUMBER) & (kind[1:] == LITERAL) & _in(value[1:], UNIT_HASHES)
        unit[w.first[:-1][w.first[:-1] < len(kind)]] = False
        kind[unit] = UNIT
    return Tokens(w.start, w.first, kind, value, np.where(kind > 0, _MARKS[kind], value))


def windows(t: Tokens, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the n-token windows that lie in one document and are half literal at least."""
    h = ngram_hashes(t.canonical, n)
    if not len(h):
        return np.zeros(0, np.int64), h
    doc = np.repeat(np.arange(len(t.first) - 1), np.diff(t.first))
    literal = np.zeros(len(t.kind) + 1, np.int64)
    np.cumsum(t.kind == LITERAL, out=literal[1:])
    at = np.flatnonzero((doc[: len(h)] == doc[n - 1 :]) & (2 * (literal[n:] - literal[:-n]) >= n))
    return at, h[at]


@dataclass
class Block:
    """Items in one form. by_n: window length -> sorted trigger hashes and, for each, its item's number."""

    ids: list[int]
    n: list[int]
    hashes: list[np.ndarray]
    at: list[np.ndarray]
    slots: list[np.ndarray]  # positions of the windows with names as slots; those with names as words come after
    kind: list[np.ndarray]
    value: list[np.ndarray]
    by_n: dict[int, tuple[np.ndarray, np.ndarray]]


def _new() -> Block:
    return Block([], [], [], [], [], [], [], {})


@dataclass
class Index:
    """One broadcast block of the benchmark, in all the forms that its items are matched in."""

    templates: Block
    values: Block
    marked: Block  # templates with marks
    marked_values: Block
    lines: tuple[np.ndarray, np.ndarray]  # sorted hashes of whole lines with marks, and the items'

    @property
    def with_marks(self) -> bool:
        return bool(self.marked.ids or self.marked_values.ids or len(self.lines[0]))


def block(items: list[tuple[int, str]], window: int = WINDOW, coverage: float = COVERAGE) -> Index:
    """Prepares items for the join. Equal templates are merged under their smallest id."""
    out = Index(_new(), _new(), _new(), _new(), (np.zeros(0, U64), np.zeros(0, np.int64)))
    seen: dict[bool, dict[bytes, int]] = {False: {}, True: {}}
    seen_values: dict[bool, set[bytes]] = {False: set(), True: set()}
    lines: dict[int, int] = {}

    def template(item: int, chunk: Chunk, t: Tokens, n: int, marks: bool) -> int | None:
        """Adds the item's template, and gives the item that it goes under; None if it has none."""
        # Templates with unlike patterns of equal slots are unlike questions.
        _, first, pattern = np.unique(np.where(t.kind > 0, t.value, U64(0)), return_index=True, return_inverse=True)
        key = t.canonical.tobytes() + first[pattern].tobytes()
        if key in seen[marks]:
            return seen[marks][key]
        # Once with names as slots and once, for texts whose case shows none, with names as they are.
        both = [windows(x, n) for x in (t, canonical(chunk, False, marks))]
        if not (len(both[0][1]) or len(both[1][1])):
            return None
        seen[marks][key] = item
        at, h = (np.concatenate(x) for x in zip(*both))
        _append(out.marked if marks else out.templates, item, n, at, h, both[0][0], t)
        return item

    def by_value(item: int, t: Tokens, n: int, marks: bool) -> None:
        if (values := t.value.tobytes()) not in seen_values[marks]:
            seen_values[marks].add(values)
            _append(out.marked_values if marks else out.values, item, n, *windows(_plain(t), n), None, _plain(t))

    for item, text in sorted((i, t) for i, t in items if i is not None and t):
        raw = text.encode()
        chunk = Chunk(range(1), np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        t = canonical(chunk)
        n = min(window, len(t.kind))
        if n >= MIN_TOKENS:
            under = template(item, chunk, t, n, False)
            by_value(item if under is None else under, t, n, False)
            if under is not None:
                continue
        d = canonical(chunk, marks=True)
        m = min(window, len(d.kind))
        if m >= MIN_TOKENS:
            under = template(item, chunk, d, m, True)
            if n < MIN_TOKENS:
                by_value(item if under is None else under, d, m, True)
        elif m:
            lines.setdefault(int(_line_hashes(d, np.array([0]), np.array([m]))[0]), item)
    for b in (out.templates, out.values, out.marked, out.marked_values):
        _set_triggers(b, coverage)
    if lines:
        keys = np.array(sorted(lines), U64)
        out.lines = keys, np.array([lines[int(k)] for k in keys], np.int64)
    return out


def _line_hashes(t: Tokens, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hashes of the values of runs of tokens."""
    return run_hashes(prefix_sums(t.value), first, last)


def _plain(t: Tokens) -> Tokens:
    """The tokens by their values, none a placeholder."""
    return Tokens(t.start, t.first, np.zeros_like(t.kind), t.value, t.value)


def _append(b: Block, item: int, n: int, at: np.ndarray, h: np.ndarray, slots: np.ndarray | None, t: Tokens) -> None:
    for name, x in (("ids", item), ("n", n), ("hashes", h), ("at", at), ("slots", at if slots is None else slots), ("kind", t.kind), ("value", t.value)):
        getattr(b, name).append(x)


def _set_triggers(out: Block, coverage: float) -> None:
    often = Counter(int(x) for h in out.hashes for x in np.unique(h))
    triggers: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for k, whole in enumerate(out.hashes):
        cut = len(out.slots[k])
        for h in (whole[:cut], whole[cut:]):  # a document shows one of the two forms
            # Coverage counts windows: without any of these, too few are left.
            rare = sorted(range(len(h)), key=lambda j: (often[int(h[j])], int(h[j])))
            need = len(h) - int(np.ceil(coverage * min(len(h), cut or len(h)))) + 1
            triggers[out.n[k]] += [(x, k) for x in {int(h[j]) for j in rare[:need]}]
    for n, pairs in triggers.items():
        pairs.sort()
        out.by_n[n] = (np.array([p[0] for p in pairs], U64), np.array([p[1] for p in pairs], np.int64))


def blocks(benchmark: DataFrame, limit: int = BLOCK_BYTES) -> Iterator[Index]:
    """The benchmark in blocks of bounded size, read as a stream."""
    held, size = [], 0
    for r in benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").toLocalIterator():
        held.append((r["item_id"], r["text"]))
        size += len(r["text"] or "")
        if size >= limit:
            yield block(held)
            held, size = [], 0
    if held:
        yield block(held)


def _item_match(b: Block, k: int, order: np.ndarray, hashes: np.ndarray, at: np.ndarray, kind: np.ndarray, value: np.ndarray) -> tuple[float, int]:
    """Share of item k's windows that consistent diagonals cover, and the number of slots whose value was changed.

    ``hashes`` are the document's window hashes in the sorted ``order``, ``at`` their token positions."""
    want, n = b.hashes[k], b.n[k]
    lo, hi = np.searchsorted(hashes, want, "left"), np.searchsorted(hashes, want, "right")
    size = hi - lo
    j = np.repeat(np.arange(len(want)), size)
    place = np.repeat(lo - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(int(size.sum()))
    diagonal = at[order[place]] - b.at[k][j]
    covered, changed = np.zeros(len(b.kind[k]), bool), 0
    ds, seen, count = np.unique(diagonal, return_index=True, return_counts=True)
    by = np.argsort(diagonal, kind="stable")
    end = np.cumsum(count)
    for i in np.lexsort((seen, -count)).tolist():  # the fullest first, of equal ones the one seen first
        if covered[b.at[k]].all():  # what more there is can add nothing
            break
        d = int(ds[i])
        mine = np.unique(b.at[k][j[by[end[i] - count[i] : end[i]]]])
        if covered[mine].all():
            continue
        slots = np.unique((mine[:, None] + np.arange(n)).ravel())
        slots = slots[b.kind[k][slots] > 0]
        there, here = b.value[k][slots].tolist(), value[slots + d].tolist()
        forth, back, bad = {}, {}, 0
        for x, y in zip(there, here):
            if forth.setdefault(x, y) != y or back.setdefault(y, x) != x:
                bad += 1
        if bad > MAX_CONFLICTS * len(slots):
            continue
        covered[mine] = True
        changed += sum(x != y for x, y in zip(there, here))
    return min(1.0, float(covered.sum()) / (len(b.slots[k]) or len(want))), changed


def matches(chunk: Chunk, b: Index, coverage: float = COVERAGE) -> dict[int, list[tuple[int, float, int]]]:
    """Contaminated documents of a chunk: number -> (item_id, coverage, changed slots)."""
    t = canonical(chunk)
    out: dict[int, list[tuple[int, float, int]]] = defaultdict(list)
    _find(t, b.templates, coverage, out)
    _find(_plain(t), b.values, coverage, out)
    if b.with_marks:
        t = canonical(chunk, marks=True)
        _find(_plain(t), b.marked_values, coverage, out)
        _find(t, b.marked, coverage, out)
        _find_lines(t, chunk, b.lines, out)
    return out


def _lines(t: Tokens, chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The document of each token, the first token of each line that has any, and the line's hash."""
    doc = np.repeat(np.arange(len(t.first) - 1), np.diff(t.first))
    line = np.searchsorted(np.flatnonzero(chunk.data == 10), t.start)
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (line[1:] != line[:-1])
    first = np.flatnonzero(new)
    return doc, first, _line_hashes(t, first, np.append(first[1:], len(doc)))


def _find_lines(t: Tokens, chunk: Chunk, lines: tuple[np.ndarray, np.ndarray], out: dict[int, list[tuple[int, float, int]]]) -> None:
    """Adds the items that are a line of a document."""
    keys, items = lines
    if not (len(keys) and len(t.value)):
        return
    doc, first, h = _lines(t, chunk)
    for k in np.flatnonzero(_in(h, keys)).tolist():
        item, d = int(items[np.searchsorted(keys, h[k])]), int(doc[first[k]])
        if all(item != i for i, _, _ in out.get(d, ())):
            out[d].append((item, 1.0, 0))


def _find(t: Tokens, b: Block, coverage: float, out: dict[int, list[tuple[int, float, int]]]) -> None:
    """Adds the items of ``b`` to ``out``, where they are not in it."""
    for n, (keys, item) in b.by_n.items():
        at, h = windows(t, n)
        hit = np.flatnonzero(_in(h, keys))
        if not len(hit):
            continue
        doc = np.searchsorted(t.first, at, "right") - 1
        for d in np.unique(doc[hit]).tolist():
            lo, hi = np.searchsorted(doc, [d, d + 1])
            own, h_own = at[lo:hi], h[lo:hi]
            order = np.argsort(h_own, kind="stable")
            got = np.unique(h_own[_in(h_own, keys)])
            first, last = np.searchsorted(keys, got, "left"), np.searchsorted(keys, got, "right")
            for k in sorted({int(x) for f, e in zip(first, last) for x in item[f:e]}):
                if any(b.ids[k] == i for i, _, _ in out.get(d, ())):
                    continue
                share, changed = _item_match(b, k, order, h_own[order], own, t.kind, t.value)
                if share >= coverage:
                    out[d].append((b.ids[k], share, changed))


HITS = "array<struct<item_id: long, coverage: double, changed_slots: long>>"
_HITS = pa.list_(pa.struct([("item_id", pa.int64()), ("coverage", pa.float64()), ("changed_slots", pa.int64())]))


def _hit_rows(chunk: Chunk, b: Index, n: int) -> list[list[dict]]:
    """The hits of each row of a batch of n; those of other chunks stay empty."""
    out: list[list[dict]] = [[] for _ in range(n)]
    for d, found in matches(chunk, b).items():
        out[chunk.rows[d]] = [{"item_id": i, "coverage": c, "changed_slots": s} for i, c, s in found]
    return out


def _scanned(rows: DataFrame, b: Index, keep: list[str]) -> DataFrame:
    """The kept columns of rows and their hits with one block, which is broadcast: BLOCK_BYTES of text and its windows."""
    held = rows.sparkSession.sparkContext.broadcast(b)
    names = [*keep, "hits"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            for chunk in chunks(batch.column("text")):
                for k, found in zip(chunk.rows, _hit_rows(chunk, held.value, batch.num_rows)[chunk.rows.start : chunk.rows.stop]):
                    hits[k] = found
            yield pa.record_batch([*(batch.column(c) for c in keep), pa.array(hits, _HITS)], names=names)

    return rows.mapInArrow(scan, ", ".join(f"{c} long" for c in keep) + f", hits {HITS}")


def _forms(b: Index) -> list[tuple[int, Block, bool, bool]]:
    """(number, block, whether tokens include marks, whether windows are of values)."""
    return [(0, b.templates, False, False), (1, b.values, False, True), (2, b.marked, True, False), (3, b.marked_values, True, True)]


def _spread(h: np.ndarray, form: int, n: int) -> np.ndarray:
    """Window hashes of one form and length, apart from those of all others."""
    return mixed(h + U64((form * 64 + n) * 0xA24BAED4963EE407 % (1 << 64)))


def _trigger_keys(b: Index) -> np.ndarray:
    keys = [_spread(k, form, n) for form, block_, _, _ in _forms(b) for n, (k, _) in block_.by_n.items()]
    return np.unique(np.concatenate([np.zeros(0, U64), *keys, _spread(b.lines[0], 4, 0)]))


def _probe_keys(chunk: Chunk, lengths: set[tuple[int, int]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(document, key) of all windows of a chunk that could be a trigger's; lengths: the (form, n) that triggers have."""
    plain = canonical(chunk)
    marked = canonical(chunk, marks=True) if any(form > 1 for form, _ in lengths) else plain
    for form, n in sorted(lengths):
        t = marked if form > 1 else plain
        if form == 4:
            if len(t.value):
                doc, first, h = _lines(t, chunk)
                yield doc[first], _spread(h, 4, 0)
            continue
        at, h = windows(_plain(t) if form % 2 else t, n)
        yield np.searchsorted(t.first, at, "right") - 1, _spread(h, form, n)


def _many(texts: DataFrame, first: Iterator[Index]) -> DataFrame:
    """__a, __b and hits of the distinct texts (__a, __b, text) that match a benchmark of several blocks.

    The driver holds one block at a time. All blocks' triggers are written to a table (key, block), and a bitmap of them,
    TRIGGER_BITS / 8 bytes, is broadcast; the windows that it lets through are hash-joined with that table. So each text
    meets the blocks that share a trigger with it, and no others, one small job a block."""
    spark = texts.sparkSession
    bits, lengths, n_blocks = np.zeros(TRIGGER_BITS // 8, np.uint8), set(), 0
    path, kept = work_path(spark, "triggers"), tempfile.TemporaryFile()  # the driver's own; no other process reads it
    places = []
    for b in first:
        keys = _trigger_keys(b)
        slot = (keys & U64(TRIGGER_BITS - 1)).astype(np.int64)
        np.bitwise_or.at(bits, slot >> 3, (1 << (slot & 7)).astype(np.uint8))
        lengths |= {(form, n) for form, block_, _, _ in _forms(b) for n in block_.by_n} | ({(4, 0)} if len(b.lines[0]) else set())
        spark.createDataFrame(pa.table({"key": pa.array(keys.view(np.int64)), "block": pa.array(np.full(len(keys), n_blocks, np.int32))})).write.mode("append").parquet(path)
        places.append(kept.tell())
        pickle.dump(b, kept)
        n_blocks += 1
    held = spark.sparkContext.broadcast((bits, lengths))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, lengths = held.value
        for batch in batches:
            a, b = (np.asarray(batch.column(c)) for c in ("__a", "__b"))
            for chunk in chunks(batch.column("text")):
                for doc, keys in _probe_keys(chunk, lengths):
                    slot = (keys & U64(TRIGGER_BITS - 1)).astype(np.int64)
                    hit = np.flatnonzero(bits[slot >> 3] >> (slot & 7).astype(np.uint8) & 1)
                    if len(hit):
                        pairs = np.unique(np.stack([doc[hit], keys[hit].view(np.int64)]), axis=1)
                        row = chunk.rows.start + pairs[0]
                        yield pa.record_batch({"key": pa.array(pairs[1]), "__a": pa.array(a[row]), "__b": pa.array(b[row])})

    triggers = spark.read.schema("key long, block int").parquet(path)
    meets = texts.mapInArrow(probe, "key long, __a long, __b long").join(triggers, "key").select("block", "__a", "__b").distinct()
    asked = checkpointed(meets.join(texts, ["__a", "__b"]).select("block", "__a", "__b", "text"))
    out = None
    for k, at in enumerate(places):
        kept.seek(at)
        found = checkpointed(_scanned(asked.where(F.col("block") == k), pickle.load(kept), ["__a", "__b"]).where(F.size("hits") > 0))
        out = found if out is None else out.unionByName(found)
    kept.close()
    return out.groupBy("__a", "__b").agg(F.flatten(F.collect_list("hits")).alias("hits"))  # of one text, a row a block


def _texts(docs: DataFrame) -> tuple[DataFrame, list]:
    """Distinct texts under two hashes, and the expressions of these."""
    text = F.coalesce(F.col("text"), F.lit(""))
    names = [F.xxhash64(text).alias("__a"), F.xxhash64(F.lit(3), text).alias("__b")]
    return docs.select(*names, text.alias("text")).groupBy("__a", "__b").agg(F.first("text").alias("text")), names


def _blocks_of(benchmark: DataFrame) -> tuple[Index | None, Iterator[Index] | None]:
    """The benchmark's only block, or None and all of several."""
    each = blocks(benchmark)
    one, two = next(each, None), next(each, None)
    return (one, None) if two is None else (None, chain((one, two), each))


def with_hits(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id and hits, the benchmark items found in it, for every document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    one, several = _blocks_of(benchmark)
    none = F.array().cast(HITS)
    if several is not None:
        texts, names = _texts(rows)
        got = rows.select("doc_id", *names).join(_many(texts, several), ["__a", "__b"], "left")
        return got.select("doc_id", F.array_sort(F.coalesce("hits", none)).alias("hits"))
    if one is None:
        return rows.select("doc_id", none.alias("hits"))
    return _scanned(rows, one, ["doc_id"]).select("doc_id", F.array_sort("hits").alias("hits"))


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without the contaminated ones, all columns as they were."""
    one, several = _blocks_of(benchmark)
    if several is not None:
        texts, names = _texts(docs)
        packed = docs.select(F.struct(*(F.col("`" + c.replace("`", "``") + "`") for c in docs.columns)).alias("row"), *names)  # no name of theirs meets ours
        return packed.join(_many(texts, several).select("__a", "__b"), ["__a", "__b"], "left_anti").select("row.*")
    if one is None:
        return docs
    held = docs.sparkSession.sparkContext.broadcast(one)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            for chunk in chunks(batch.column("text")):
                keep[[chunk.rows[d] for d in matches(chunk, held.value)]] = False
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(clean, docs.schema)


def op1_template_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = with_hits(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return got.select(
        "doc_id",
        (F.size("hits") > 0).alias("contaminated"),
        F.transform("hits", lambda x: x["item_id"]).alias("items"),
        F.coalesce(F.array_max(F.transform("hits", lambda x: x["coverage"])), F.lit(0.0)).alias("coverage"),
        F.coalesce(F.array_max(F.transform("hits", lambda x: x["changed_slots"])), F.lit(0)).alias("changed_slots"),
    )
