"""Where repeated windows can be, and how they reach the index that decides on them.

Substring dedup removes what lies in a window (N symbols: words or bytes) that also starts earlier in the corpus. Sending
every window through a shuffle would multiply the corpus, so it is cut into fragments first. Of a window's k-grams the
one with the smallest hash is its anchor; a fragment is a maximal run of windows with one anchor. Equal windows have
equal anchors, so only fragments with equal anchors need be compared, and fragments whose anchor occurs once, by far
the most, are done with. All others go through the operator's index (``Kind.decide``), which decides on every window:
the hashes say what is compared and which contents need be sent once only, never what is removed.

0. An anchor that very many unlike fragments share, as the end of a licence line does, would bring them all to one task.
   A hash sample of documents shows which anchors these are (``hot_anchors``); their fragments are cut into single
   windows, whose anchor is their own hash, so that they go to all shards. The sample decides on the load only: the rows
   are the same whatever it finds.

1. A task reads its documents in units of UNIT_BYTES. What a unit holds UNIT_COPIES times or more it indexes itself: the first
   place of each content stays, the windows of its later places are asked of the index and settled. So a passage in a third
   of all rows leaves a unit once. What stays goes to the bucket of its anchor as 18 bytes a fragment.
2. In a bucket, an anchor with one place left has no more repeats. Of every other anchor, each content has a leading
   place, the first in the corpus, and echoes, its later places.
3. Contents are cut from their leading documents and brought together by anchor, each with its echoes. The index takes
   the contents in corpus order and tells which windows of a content an earlier one holds, for its leading place, and
   which the index holds once the content itself is in it, for its echoes.
4. Documents get their repeated windows and drop what those cover. Documents without any are finished where they are read.

Buckets, and not partitions, are what a task holds: rows are sorted by bucket, which Spark does on disk, and handled bucket
by bucket. Their number comes from the size of the input, so a task needs the memory of one bucket, of one unit or of one
run of the index, however much of the corpus its partition holds.

Texts move twice, those of documents with leading places (step 3) and of documents with repeats (step 4), as bitmaps over
hashed keys show. A bitmap has FILTER_BITS bits for each such document, MOST_FILTER_BITS at most; beyond that, from some
30 million such documents on, it lets more and more of the other texts through, in the end all, which costs shuffles of
up to twice the text and changes no row.

Order within an anchor: an earlier fragment of the same document starts earlier, windows of one fragment are all unlike
(their anchor stands elsewhere in each), so "also starts earlier" is "is in an earlier fragment".

Documents: a row is known by its doc_id. Where rows have none, or share one, a row is known by its doc_id and text: keys
are then numbers in the order of doc_id (none first) and hashes of the text. Rows that agree in both count as one document
and get the same result. Hashes have 64 bits and are compared under 32 bits of the anchor and its bucket, those of texts 128.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Chunk, checkpointed, chunks, mixed, parts, prefix_sums, run_hashes, trim, work_path

FILTER_BITS, MOST_FILTER_BITS = 8, 1 << 28  # 32 MB
SAMPLE = 64  # one of so many documents shows the hot anchors
HOT = 1024  # from so many unlike fragments on, by the sample's estimate, an anchor is hot
HOT_ANCHORS = 1 << 21  # most hot anchors, 8 bytes each in the broadcast; with more, the limit for being hot rises
UNIT_BYTES = 8 << 20  # text of the documents that a task merges at a time
UNIT_COPIES = 4  # places of a content in one unit from which on the unit settles the later ones
BUCKET_BYTES = 16 << 20  # text, about, whose fragments are in one bucket
BUCKETS_A_PART = 8  # buckets of a partition at least
LEAD = np.dtype([("doc", "<i8"), ("start", "<u4"), ("windows", "<u2"), ("anchor", "<u8"), ("echoes", "<u4")])
ECHO = np.dtype([("doc", "<i8"), ("start", "<u4")])
PLACE = np.dtype([("doc", "<i8"), ("start", "<u4"), ("windows", "<u4")])
RUN = np.dtype([("start", "<u4"), ("windows", "<u4")])
REPEAT = np.dtype([("fragment", "<i8"), ("first", "<i8"), ("windows", "<i8")])


@dataclass(frozen=True)
class Kind:
    """What a window is made of, and how a document is finished.

    values: a chunk's symbols as hashes, and the symbol at which each document begins. cutter: of a text, what gives the
    bytes of ``n`` symbols from symbol ``start``. finish: (columns of the result) of a text without the symbols in the given
    intervals. decide: the index. Of contents in the order of (anchor, first place), and which of them are wanted whole,
    it tells as runs of windows (REPEAT) what earlier contents hold, and of those wanted whole, what the index holds
    with them in it. shard_bytes: contents that the index takes at a time, or one anchor's."""

    window: int
    gram: int
    values: Callable[[Chunk], tuple[np.ndarray, np.ndarray]]
    cutter: Callable[[bytes], Callable[[int, int], bytes]]
    finish: Callable[[bytes, np.ndarray], tuple]
    decide: Callable[[list[bytes], np.ndarray], tuple[np.ndarray, np.ndarray]]
    columns: str
    symbol_bytes: int  # of a content, about
    shard_bytes: int


def sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive values, by prefix and suffix minima of blocks of w."""
    n = len(v)
    blocks = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, U64)
    blocks[:n] = v
    blocks = blocks.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - w + 1], ahead[w - 1 : n])


NO_HOT = np.zeros(0, U64)


def find(values: np.ndarray, first: np.ndarray, window: int, gram: int, hot: np.ndarray = NO_HOT) -> tuple[np.ndarray, ...]:
    """(document, start in it, windows, anchor hash, content hash) of every fragment. Those of the anchors in ``hot``, which
    is in order, are cut into windows, and the anchor of such a window is a hash of all of it."""
    n = len(values)
    none = np.zeros(0, np.int64)
    if n < window:
        return none, none, none, none.astype(U64), none.astype(U64)
    prefix = prefix_sums(values)
    at = np.arange(n - gram + 1)
    grams = run_hashes(prefix, at, at + gram)
    # The leftmost of the smallest: 32 bits of hash above the position.
    low = sliding_min((grams & U64(0xFFFFFFFF00000000)) | at.astype(U64), window - gram + 1)
    doc = np.repeat(np.arange(len(first) - 1, dtype=np.int32), np.diff(first))
    j = np.flatnonzero(doc[: n - window + 1] == doc[window - 1 :])
    if not len(j):
        return none, none, none, none.astype(U64), none.astype(U64)
    anchor = (low[j] & U64(0xFFFFFFFF)).astype(np.int64)
    new = np.ones(len(j), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (j[1:] != j[:-1] + 1)
    lo = np.flatnonzero(new)
    hi = np.append(lo[1:], len(j)) - 1
    a, b, anchor = j[lo], j[hi], grams[anchor[lo]]
    if not len(hot):
        return doc[a].astype(np.int64), a - first[doc[a]], b - a + 1, anchor, run_hashes(prefix, a, b + window)
    wide = hot[np.minimum(np.searchsorted(hot, anchor), len(hot) - 1)] == anchor
    pieces = np.where(wide, b - a + 1, 1)
    wide, anchor = np.repeat(wide, pieces), np.repeat(anchor, pieces)
    nth = np.arange(len(wide)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    a, b = np.repeat(a, pieces) + nth, np.repeat(b, pieces)
    b[wide] = a[wide]
    content = run_hashes(prefix, a, b + window)
    return doc[a].astype(np.int64), a - first[doc[a]], b - a + 1, np.where(wide, mixed(anchor ^ content), anchor), content


def hot_anchors(rows: DataFrame, kind: Kind, hot: int = HOT, sample: int = SAMPLE, most: int = HOT_ANCHORS) -> np.ndarray:
    """Hashes, in order, of the anchors that ``hot`` or more unlike fragments share by the estimate of a hash sample of one
    in ``sample`` documents; if there are more than ``most``, of the commonest of them. The driver gets 8 bytes for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column("text")):
                _, _, _, anchor, content = find(*kind.values(chunk), kind.window, kind.gram)
                yield pa.record_batch({"anchor": pa.array(anchor.view(np.int64)), "content": pa.array(content.view(np.int64))})

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch({"anchors": pa.array([np.asarray(batch.column("anchor")).tobytes()], pa.binary())})

    drawn = rows.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(sample)) == 0).mapInArrow(run, "anchor long, content long")
    least = max(2, -(-hot // sample))
    common = checkpointed(drawn.distinct().groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least))
    while common.where(F.col("n") >= least).count() > most:
        least *= 2
    packed = common.where(F.col("n") >= least).select("anchor").mapInArrow(pack, "anchors binary").collect()
    return np.sort(np.frombuffer(b"".join(bytes(r["anchors"]) for r in packed), U64))


def _cuts(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each run of rows with equal keys begins and ends."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0) if len(keys[0]) > 1 else True
    at = np.flatnonzero(new)
    return at, np.append(at[1:], len(keys[0])) if len(at) else at


def _joined(places: np.ndarray) -> np.ndarray:
    """The same windows with runs that follow each other in a document made one."""
    if not len(places):
        return places
    places = places[np.lexsort((places["start"], places["doc"]))]
    doc, start, windows = places["doc"], places["start"].astype(np.int64), places["windows"].astype(np.int64)
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + windows[:-1])
    cut = np.flatnonzero(new)
    last = np.append(cut[1:], len(doc)) - 1
    return _places(doc[cut], start[cut], start[last] + windows[last] - start[cut])


def _places(doc: np.ndarray, start: np.ndarray, windows: np.ndarray) -> np.ndarray:
    out = np.zeros(len(doc), PLACE)
    out["doc"], out["start"], out["windows"] = doc, start, windows
    return out


def _ordered(anchor: np.ndarray, content: np.ndarray, doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fragments in the order of (anchor, content, doc, start), each place once; and which of these lead their content."""
    order = np.lexsort((start, doc, content, anchor))
    lead, other = np.ones(len(order), bool), np.ones(len(order), bool)
    lead[1:] = (anchor[order[1:]] != anchor[order[:-1]]) | (content[order[1:]] != content[order[:-1]])
    other[1:] = lead[1:] | (doc[order[1:]] != doc[order[:-1]]) | (start[order[1:]] != start[order[:-1]])
    return order[other], lead[other]


def _repeated(values: np.ndarray) -> np.ndarray:
    """Positions of the values that occur more than once, in their order."""
    order = np.argsort(values, kind="stable")
    twice = np.zeros(len(order), bool)
    twice[1:] = values[order[1:]] == values[order[:-1]]
    twice[:-1] |= twice[1:]
    return order[twice]


def _told(kind: Kind, contents: list[bytes], leads: np.ndarray, counts: np.ndarray, echoes: np.ndarray) -> np.ndarray:
    """What the index says of contents, as places. leads (doc, start): the first place of each; ``counts`` of the
    ``echoes`` (doc, start) belong to each in turn."""
    first, whole = kind.decide(contents, counts > 0)
    f = first["fragment"]
    out = [_places(leads["doc"][f], leads["start"][f] + first["first"], first["windows"])]
    if len(whole):
        f, n = whole["fragment"], counts[whole["fragment"]]
        at = np.cumsum(counts) - counts
        which = np.repeat(at[f], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        out.append(_places(echoes["doc"][which], echoes["start"][which] + np.repeat(whole["first"], n), np.repeat(whole["windows"], n)))
    return np.concatenate(out)


_SHARDED = "dest int, anchor binary, content binary, doc binary, start binary, windows binary, settled binary"


def _sharded(rows: DataFrame, kind: Kind, buckets: int, hot: np.ndarray) -> DataFrame:
    """Step 1: what stays of each unit, by bucket of the anchor, and what the unit settled, by bucket of the document."""
    common = rows.sparkSession.sparkContext.broadcast(hot)
    names = [c.split()[0] for c in _SHARDED.split(", ")]

    def batch_of(dest: np.ndarray, **cols: list) -> pa.RecordBatch:
        some = {c: pa.array(cols[c], pa.binary()) if c in cols else pa.nulls(len(dest), pa.binary()) for c in names[1:]}
        return pa.record_batch({"dest": pa.array(dest, pa.int32()), **some})

    def unit(texts: list[Chunk], held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        doc, start, windows, anchor, content, chunk, local = (np.concatenate(x) for x in zip(*held))
        keep = np.ones(len(doc), bool)
        multi = _repeated(content)
        if len(multi):
            order, lead = _ordered(anchor[multi], content[multi], doc[multi], start[multi])
            keep[multi] = False
            order = multi[order]
            keep[order[lead]] = True
            at, end = np.flatnonzero(lead), np.append(np.flatnonzero(lead)[1:], len(order))
            few = end - at < UNIT_COPIES
            keep[order[np.repeat(few, end - at)]] = True
            some = np.flatnonzero(~few)
            first = order[at[some]]
            some = some[np.lexsort((start[first], doc[first], anchor[first]))]
            settled = []
            for lo, hi in _shares(kind, windows[order[at[some]]]):
                a, e = at[some[lo:hi]], end[some[lo:hi]]
                first, n = order[a], e - a - 1
                echoes = order[np.repeat(a + 1 - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
                contents = _contents(kind, texts, chunk[first], local[first], start[first], windows[first])
                settled.append(_told(kind, contents, _places(doc[first], start[first], windows[first]), n, _places(doc[echoes], start[echoes], windows[echoes])))
            if settled:
                places = _joined(np.concatenate(settled))
                dest = _bucket(places["doc"], buckets)
                order = np.argsort(dest, kind="stable")
                places, dest = places[order], dest[order]
                lo, hi = _cuts(dest)
                yield batch_of(dest[lo], settled=[places[x:y].tobytes() for x, y in zip(lo, hi)])
        k = np.flatnonzero(keep)
        dest = ((anchor[k] & U64(0xFFFFFFFF)) % U64(buckets)).astype(np.int32)
        order = np.argsort(dest, kind="stable")
        k, dest = k[order], dest[order]
        out: dict[str, list] = {c: [] for c in ("anchor", "content", "doc", "start", "windows")}
        lo, hi = _cuts(dest)
        for x, y in zip(lo.tolist(), hi.tolist()):
            part = k[x:y]
            base = doc[part].min()
            wide = int(doc[part].max()) - int(base) >= 1 << 32
            out["anchor"].append((anchor[part] >> U64(32)).astype("<u4").tobytes())
            out["content"].append(content[part].astype("<u8").tobytes())
            out["doc"].append(np.int64(base).tobytes() + (doc[part] - base).view(U64).astype("<u8" if wide else "<u4").tobytes())
            out["start"].append(start[part].astype("<u4").tobytes())
            out["windows"].append(windows[part].astype("u1" if kind.window <= 255 else "<u2").tobytes())
        if len(lo):
            yield batch_of(dest[lo], **out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, held, size = [], [], 0
        for batch in batches:
            keys = np.asarray(batch.column("__key"))
            for chunk in chunks(batch.column("text")):
                values, first = kind.values(chunk)
                doc, *rest = find(values, first, kind.window, kind.gram, common.value)
                if not len(doc):
                    continue
                held.append((keys[chunk.rows.start + doc], *rest, np.full(len(doc), len(texts)), doc))
                texts.append(chunk)
                size += len(chunk.data)
                if size >= UNIT_BYTES:
                    yield from unit(texts, held)
                    texts, held, size = [], [], 0
        if held:
            yield from unit(texts, held)
        texts.clear(), held.clear()
        trim()

    return rows.mapInArrow(run, _SHARDED)


def _bucket(doc: np.ndarray, buckets: int) -> np.ndarray:
    return (mixed(np.ascontiguousarray(doc).view(U64)) % U64(buckets)).astype(np.int32)


def _shares(kind: Kind, windows: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of contents of about ``shard_bytes``. What a cut parts is told in step 3."""
    if not len(windows):
        return
    total = np.cumsum((windows + kind.window) * kind.symbol_bytes)
    share = total // kind.shard_bytes
    lo, hi = _cuts(share)
    yield from zip(lo.tolist(), hi.tolist())


def _contents(kind: Kind, texts: list[Chunk], chunk: np.ndarray, local: np.ndarray, start: np.ndarray, windows: np.ndarray) -> list[bytes]:
    """The contents of fragments of a unit; a text is cut up once for all of its own."""
    out: list[bytes] = [b""] * len(chunk)
    order = np.lexsort((local, chunk))
    lo, hi = _cuts(chunk[order], local[order])
    for x, y in zip(lo.tolist(), hi.tolist()):
        cut = kind.cutter(texts[chunk[order[x]]].text(int(local[order[x]])))
        for k in order[x:y].tolist():
            out[k] = cut(int(start[k]), int(windows[k]) + kind.window - 1)
    return out


def _by(column: str, batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """Batches sorted by a column, cut into whole runs of equal values."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        values = np.asarray(batch.column(column))
        lo, hi = _cuts(values)
        for x, y in zip(lo.tolist(), hi.tolist()):
            if held and held[-1].column(column)[-1].as_py() != values[x]:
                yield held
                held = []
            held.append(batch.slice(x, y - x))
    if held:
        yield held


def _dealt(df: DataFrame, by: str, n: int) -> DataFrame:
    """Rows by bucket: each in one of n partitions, sorted there."""
    return df.repartitionById(n, F.col(by) % n).sortWithinPartitions(by)


def _blocks(places: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """Places by bucket of their document, a row for each bucket."""
    block = _bucket(places["doc"], buckets)
    order = np.argsort(block, kind="stable")
    places, block = places[order], block[order]
    lo, hi = _cuts(block)
    if len(lo):
        yield pa.record_batch({"block": pa.array(block[lo], pa.int32()), "places": pa.array([places[x:y].tobytes() for x, y in zip(lo, hi)], pa.binary())})


_FOUND = "__key long, leads binary, echoes binary, settled binary"


def _merged(sharded: DataFrame, kind: Kind, buckets: int) -> DataFrame:
    """Step 2: a row for each document that has leading places or settled windows."""
    size = np.dtype("u1" if kind.window <= 255 else "<u2")
    n = parts(sharded.sparkSession)

    def judge(bucket: int, group: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Leading places of the anchors with several places, their echoes in the same order, and settled places."""
        held, settled = [], [np.zeros(0, PLACE)]
        for batch in group:
            settled += [np.frombuffer(x, PLACE) for x in batch.column("settled").to_pylist() if x is not None]
            for anchor, content, doc, start, windows in zip(*(batch.column(c).to_pylist() for c in ("anchor", "content", "doc", "start", "windows"))):
                if anchor is not None:
                    many = len(anchor) // 4
                    keys = np.frombuffer(doc, "<u4" if len(doc) == 8 + 4 * many else "<u8", offset=8).astype(np.int64) + np.frombuffer(doc, "<i8", 1)[0]
                    held.append((np.frombuffer(anchor, "<u4"), np.frombuffer(content, "<u8"), keys, np.frombuffer(start, "<u4"), np.frombuffer(windows, size)))
        leads, echoes = np.zeros(0, LEAD), np.zeros(0, ECHO)
        if held:
            anchor, content, doc, start, windows = (np.concatenate(x) for x in zip(*held))
            k = _repeated(anchor)
            order, lead = _ordered(anchor[k], content[k], doc[k], start[k])
            order = k[order]
            # Places that only repeat one another, as those of repeated rows do, leave an anchor with one place.
            lo, hi = _cuts(anchor[order])
            several = np.repeat(hi - lo > 1, hi - lo)
            order, lead = order[several], lead[several]
            at = np.flatnonzero(lead)
            first, later = order[at], order[~lead]
            leads = np.zeros(len(at), LEAD)
            leads["doc"], leads["start"], leads["windows"] = doc[first], start[first], windows[first]
            leads["anchor"] = anchor[first].astype(U64) | (U64(bucket) << U64(32))
            leads["echoes"] = np.diff(np.append(at, len(order))) - 1
            echoes = np.zeros(len(later), ECHO)
            echoes["doc"], echoes["start"] = doc[later], start[later]
        return leads, echoes, np.concatenate(settled)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _by("dest", batches):
            leads, echoes, settled = judge(group[0].column("dest")[0].as_py(), group)
            block = _bucket(leads["doc"], buckets)
            order = np.argsort(block, kind="stable")
            owner = np.repeat(np.arange(len(leads)), leads["echoes"])
            place = np.empty(len(leads), np.int64)
            place[order] = np.arange(len(order))
            echoes = echoes[np.argsort(place[owner], kind="stable")]
            leads, block = leads[order], block[order]
            ends = np.concatenate([[0], np.cumsum(leads["echoes"], dtype=np.int64)])
            lo, hi = _cuts(block)
            if len(lo):
                cut = list(zip(lo.tolist(), hi.tolist()))
                yield pa.record_batch({"block": pa.array(block[lo]), "leads": pa.array([leads[x:y].tobytes() for x, y in cut], pa.binary()), "echoes": pa.array([echoes[ends[x] : ends[y]].tobytes() for x, y in cut], pa.binary()), "settled": pa.nulls(len(lo), pa.binary())})
            block = _bucket(settled["doc"], buckets)
            order = np.argsort(block, kind="stable")
            settled, block = settled[order], block[order]
            lo, hi = _cuts(block)
            if len(lo):
                none = pa.nulls(len(lo), pa.binary())
                yield pa.record_batch({"block": pa.array(block[lo]), "leads": none, "echoes": none, "settled": pa.array([settled[x:y].tobytes() for x, y in zip(lo, hi)], pa.binary())})

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _by("block", batches):
            read = lambda c, kind: np.concatenate([np.zeros(0, kind), *(np.frombuffer(x, kind) for b in group for x in b.column(c).to_pylist() if x)])  # noqa: B023, E731
            leads, echoes, settled = read("leads", LEAD), read("echoes", ECHO), _joined(read("settled", PLACE))
            owner = np.repeat(np.arange(len(leads)), leads["echoes"])
            order = np.argsort(leads["doc"], kind="stable")
            place = np.empty(len(leads), np.int64)
            place[order] = np.arange(len(order))
            echoes, leads = echoes[np.argsort(place[owner], kind="stable")], leads[order]
            ends = np.concatenate([[0], np.cumsum(leads["echoes"], dtype=np.int64)])
            keys = np.union1d(leads["doc"], settled["doc"])
            a, b = (np.searchsorted(leads["doc"], keys, side) for side in ("left", "right"))
            c, d = (np.searchsorted(settled["doc"], keys, side) for side in ("left", "right"))
            blob = lambda x, lo, hi: x[lo:hi].tobytes() if hi > lo else None
            cut = list(zip(a.tolist(), b.tolist(), c.tolist(), d.tolist()))
            yield pa.record_batch({"__key": pa.array(keys), "leads": pa.array([blob(leads, w, x) for w, x, _, _ in cut], pa.binary()), "echoes": pa.array([blob(echoes, ends[w], ends[x]) for w, x, _, _ in cut], pa.binary()), "settled": pa.array([blob(settled, y, z) for _, _, y, z in cut], pa.binary())})

    blocks = _dealt(sharded, "dest", n).mapInArrow(run, "block int, leads binary, echoes binary, settled binary")
    return _dealt(blocks, "block", n).mapInArrow(gather, _FOUND)


def written(df: DataFrame) -> DataFrame:
    """``df`` written as a compressed table below the shared folder, and read from there."""
    path = work_path(df.sparkSession, "fragments")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@dataclass(frozen=True)
class Filter:
    """A bitmap over hashed keys: false only for keys that are not in the table it was made from."""

    size: int
    bits: np.ndarray

    def has(self, bit: np.ndarray) -> np.ndarray:
        return (self.bits[bit >> 3] >> (bit & 7).astype(np.uint8) & 1).astype(bool)


def _bit(key: str, size: int) -> F.Column:
    return F.pmod(F.xxhash64(key), F.lit(size))


def _filter(keys: DataFrame, most: int = MOST_FILTER_BITS) -> Filter:
    """The bitmap is put together where the rows are; the driver gets its pages, ``most`` / 8 bytes at most."""
    size = min(most, max(1 << 15, 1 << (FILTER_BITS * keys.count()).bit_length()))
    bits = keys.select(_bit("__key", size).alias("bit"))
    pages = bits.groupBy(F.bitmap_bucket_number(F.col("bit") + 1).alias("page")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("bit") + 1)).alias("bits"))  # these count from 1
    out = np.zeros(size // 8, np.uint8)
    for r in pages.collect():
        page = np.frombuffer(bytes(r["bits"]), np.uint8)
        out[(r["page"] - 1) * 4096 :][: len(page)] = page[: len(out)]
    return Filter(size, out)


def _intervals(runs_: np.ndarray, window: int) -> np.ndarray:
    """Disjoint (from, to) of the symbols that runs of windows (start, windows) cover."""
    if not len(runs_):
        return np.zeros((0, 2), np.int64)
    lo = np.sort(runs_["start"].astype(np.int64))
    hi = (runs_["start"].astype(np.int64) + runs_["windows"] + window - 1)[np.argsort(runs_["start"], kind="stable")]
    hi = np.maximum.accumulate(hi)
    new = np.ones(len(lo), bool)
    new[1:] = lo[1:] > hi[:-1]
    cut = np.flatnonzero(new)
    return np.stack([lo[cut], hi[np.append(cut[1:], len(lo)) - 1]], 1)


def _keyed(rows: DataFrame) -> tuple[DataFrame, int]:
    """rows (doc_id, text) with __key, and the bytes of their texts. Keys follow the order of the corpus."""
    got = rows.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("ids"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("size")).first()
    if got["n"] == got["ids"]:
        return rows.withColumn("__key", F.col("doc_id")), got["size"]
    text = F.coalesce("text", F.lit(""))
    named = rows.withColumns({"__a": F.xxhash64(text), "__b": F.xxhash64(F.lit(1), text)})
    keys = named.select("doc_id", "__a", "__b").distinct().orderBy(F.col("doc_id").asc_nulls_first(), "__a", "__b")
    keys = checkpointed(keys.withColumn("__key", F.monotonically_increasing_id())).withColumnsRenamed({"doc_id": "__id", "__a": "__c", "__b": "__d"})
    same = named["doc_id"].eqNullSafe(keys["__id"]) & (named["__a"] == keys["__c"]) & (named["__b"] == keys["__d"])
    return written(named.join(keys, same).select("doc_id", "text", "__key")), got["size"]


def deduplicated(docs: DataFrame, kind: Kind, hot: int = HOT, sample: int = SAMPLE) -> DataFrame:
    """doc_id and ``kind.columns`` for every document."""
    n = parts(docs.sparkSession)
    rows, size = _keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    buckets = min(1 << 31, max(BUCKETS_A_PART * n, -(-size // BUCKET_BYTES)))
    found = written(_merged(_sharded(rows, kind, buckets, hot_anchors(rows, kind, hot, sample)), kind, buckets))
    broadcast = docs.sparkSession.sparkContext.broadcast
    names = [c.split()[0] for c in kind.columns.split(", ")]
    types = {"long": pa.int64(), "string": pa.string()}
    kinds = [types[c.split()[1]] for c in kind.columns.split(", ")]

    # Step 3
    leading = found.where("leads is not null").select("__key", "leads", "echoes")
    asked_of = broadcast(_filter(leading))

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(asked_of.value.has(np.asarray(batch.column("bit"))))).select(["__key", "text"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 512):
                batch = whole.slice(lo, 512)
                out, contents, calls = [], [], []
                for text, leads, echoes in zip(*(batch.column(c).to_pylist() for c in ("text", "leads", "echoes"))):
                    of, at = kind.cutter((text or "").encode()), 0
                    leads, echoes = np.frombuffer(leads, LEAD), echoes or b""
                    out.append(leads)
                    for start, windows, many in zip(leads["start"].tolist(), leads["windows"].tolist(), leads["echoes"].tolist()):
                        contents.append(of(start, windows + kind.window - 1))
                        calls.append(echoes[at : at + many * ECHO.itemsize])
                        at += many * ECHO.itemsize
                if out:
                    e = np.concatenate(out)
                    yield pa.record_batch({"anchor": pa.array(e["anchor"].view(np.int64)), "doc": pa.array(e["doc"]), "start": pa.array(e["start"].astype(np.int64)), "content": pa.array(contents, pa.binary()), "echoes": pa.array(calls, pa.binary())})

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for whole in batches:
            for lo in range(0, whole.num_rows, 1024):
                batch = whole.slice(lo, 1024)
                last = np.asarray(batch.column("anchor"))
                if size >= kind.shard_bytes:  # the anchor at its end may go on
                    end = held[-1].column("anchor")[-1].as_py()
                    more = int(np.searchsorted(last, end, "right"))
                    if more < len(last):
                        yield from told([*held, batch.slice(0, more)])
                        held, size, batch = [], 0, batch.slice(more)
                held.append(batch)
                size += pc.sum(pc.binary_length(batch.column("content"))).as_py()
        if held:
            yield from told(held)
        held.clear()
        trim()

    def told(group: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What the index says of whole anchors, by block of documents. A repeated row asks the same again; it counts once."""
        doc, start, anchor = (np.concatenate([np.asarray(b.column(c)) for b in group]) for c in ("doc", "start", "anchor"))
        contents, calls = ([x for b in group for x in b.column(c).to_pylist()] for c in ("content", "echoes"))
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (start[1:] != start[:-1]) | (anchor[1:] != anchor[:-1])
        k = np.flatnonzero(new)
        calls = [calls[x] for x in k.tolist()]
        counts = np.fromiter(map(len, calls), np.int64, len(k)) // ECHO.itemsize
        places = _told(kind, [contents[x] for x in k.tolist()], _places(doc[k], start[k], 0), counts, np.frombuffer(b"".join(calls), ECHO))
        places = _joined(places)
        yield from _blocks(places, buckets)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _by("block", batches):
            places = _joined(np.concatenate([np.frombuffer(x, PLACE) for b in group for x in b.column("places").to_pylist()]))
            lo, hi = _cuts(places["doc"])
            runs_ = np.zeros(len(places), RUN)
            runs_["start"], runs_["windows"] = places["start"], places["windows"]
            yield pa.record_batch({"__key": pa.array(places["doc"][lo]), "runs": pa.array([runs_[x:y].tobytes() for x, y in zip(lo, hi)], pa.binary())})

    def settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs_ = []
            for x in batch.column("settled").to_pylist():
                p = np.frombuffer(x, PLACE)
                r = np.zeros(len(p), RUN)
                r["start"], r["windows"] = p["start"], p["windows"]
                runs_.append(r.tobytes())
            yield pa.record_batch({"__key": batch.column("__key"), "runs": pa.array(runs_, pa.binary())})

    texts = rows.select("__key", "text", _bit("__key", asked_of.value.size).alias("bit")).mapInArrow(wanted, "__key long, text string")
    asked = texts.join(leading, "__key").select("text", "leads", "echoes").mapInArrow(cut, "anchor long, doc long, start long, content binary, echoes binary")
    answers = asked.repartition(n, "anchor").sortWithinPartitions("anchor", "doc", "start").mapInArrow(decide, "block int, places binary")
    answers = _dealt(answers, "block", n).mapInArrow(gather, "__key long, runs binary")
    answers = answers.unionByName(found.where("settled is not null").select("__key", "settled").mapInArrow(settled, "__key long, runs binary"))
    gone = written(answers.groupBy("__key").agg(F.collect_list("runs").alias("runs")))  # of one document

    # Step 4
    touched = broadcast(_filter(gone))

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = _intervals(np.zeros(0, RUN), kind.window)
        for whole in batches:
            for lo in range(0, whole.num_rows, 512):
                batch = whole.slice(lo, 512)
                waits = touched.value.has(np.asarray(batch.column("bit"))).tolist()
                texts = batch.column("text").to_pylist()
                ready = [(None,) * len(names) if t else kind.finish((x or "").encode(), none) for x, t in zip(texts, waits)]
                left = pa.array([x or "" if t else None for x, t in zip(texts, waits)], pa.string())
                yield pa.record_batch([batch.column("doc_id"), batch.column("__key"), left, *(pa.array(c, t) for c, t in zip(zip(*ready), kinds))], names=["doc_id", "__key", "text", *names])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 512):
                batch = whole.slice(lo, 512)
                done = []
                for doc_id, text, runs_, *ready in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "runs", *names))):
                    done.append((doc_id, *(ready if text is None else kind.finish(text.encode(), _intervals(np.frombuffer(b"".join(runs_ or ()), RUN), kind.window)))))
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*done), [pa.int64(), *kinds])], names=["doc_id", *names])

    sifted = rows.withColumn("bit", _bit("__key", touched.value.size)).mapInArrow(sift, f"doc_id long, __key long, text string, {kind.columns}")
    return sifted.join(gone, "__key", "left").select("doc_id", "text", "runs", *names).mapInArrow(finish, f"doc_id long, {kind.columns}")
