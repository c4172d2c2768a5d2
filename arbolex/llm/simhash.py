"""SimHash near-duplicates with BK-trees.

A document's fingerprint has, for each of 64 bits, the majority over the XXH64 hashes of its 3-word shingles. Documents
link at 2 or fewer differing bits; components of links are the groups.

Equal fingerprints are first merged to one row. Of four blocks of 16 bits, two differing bits leave at least two blocks
equal, so each fingerprint goes to the six shards that its pairs of blocks name, and any two within the radius meet in
one. The trees are built where the shard's rows are instead of being broadcast, since together they grow with the
corpus. In a shard, fingerprints that are equal in the two blocks form a BK-tree, whose children are keyed by the Hamming
distance to their parent; a search follows only the edges within the radius of its own distance. A shard returns a
spanning forest of its links, at most one edge a row, never all pairs.

Very many unlike fingerprints may share two blocks, as those of one template do. Where more than MOST do, the group is
split the same way by the other 32 bits: of their four bytes two are equal, so each fingerprint goes to six smaller groups.
Such a group has 48 bits in common, so it holds 65,536 fingerprints at most, whatever the input.

Defined cases: a null, empty or blank text has fingerprint zero and links like any other; fewer than 3 words are one
shingle; repeated shingles count as often as they occur; ties (exactly half the hashes) give bit 0; an empty table gives
no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpointed, chunks, documents, parts, words
from .components import components

SHINGLE, SEED, RADIUS = 3, 42, 2
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
PAIRS = [(a, b) for a in range(4) for b in range(a)]
MOST = 2048  # fingerprints of one pair of blocks that stay in one group
BROADCAST_KEYS = 1 << 20  # beyond so many split groups their keys are joined by a shuffle instead


def fingerprints(data: np.ndarray, start: np.ndarray, end: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One 64-bit fingerprint for each run of words first[k]:first[k + 1]."""
    count = np.diff(first)
    # The words of the chunk, lower-cased and each followed by one space.
    size = end - start
    at = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size + 1, out=at[1:])
    joined = np.full(int(at[-1]), 32, np.uint8)
    inside = np.ones(len(joined), bool)
    inside[at[1:] - 1] = False
    step = np.repeat(start - at[:-1], size)
    joined[inside] = LOWER[data[np.flatnonzero(inside) + step]]
    text = joined.tobytes()
    n_shingles = np.where(count > 0, np.maximum(count - SHINGLE + 1, 1), 0)
    lo = np.repeat(first[:-1], n_shingles) + _within(n_shingles)
    hi = np.minimum(lo + SHINGLE, np.repeat(first[1:], n_shingles))
    digest = xxhash.xxh64_intdigest
    spans = zip(at[lo].tolist(), (at[hi] - 1).tolist()) if len(lo) else ()
    hashes = np.fromiter((digest(text[s:e], SEED) for s, e in spans), np.uint64, len(lo))
    return majorities(hashes, n_shingles)


def majorities(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each run of ``counts`` hashes the bits that over half of them have; zero for none."""
    out = np.zeros(len(counts), np.uint64)
    some = np.flatnonzero(counts)
    if len(some):
        edge = np.zeros(len(counts) + 1, np.int64)
        np.cumsum(counts, out=edge[1:])
        half = counts[some]
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, edge[:-1][some], axis=0, dtype=np.int32)
        out[some] = np.packbits((2 * ones > half[:, None]), axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def _within(counts: np.ndarray) -> np.ndarray:
    """0 to c - 1 for each c in turn."""
    total = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=total[1:])
    return np.arange(total[-1]) - np.repeat(total[:-1], counts)


def with_fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp, the fingerprint's bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column("text")):
                w = words(chunk)
                fp = fingerprints(chunk.data, w.start, w.end, w.first)
                yield pa.record_batch({"doc_id": batch.column("doc_id").slice(chunk.rows.start, chunk.n), "fp": pa.array(fp.view(np.int64))})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


class BKTree:
    """Nodes by number; children[k] maps a distance to the one child at that distance."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        node = len(self.values)
        self.values.append(value)
        self.children.append({})
        at = 0
        while at != node:
            at = self.children[at].setdefault((self.values[at] ^ value).bit_count(), node)

    def within(self, value: int, radius: int) -> list[int]:
        if not self.values:
            return []
        found, todo, values, children = [], [0], self.values, self.children
        while todo:
            at = todo.pop()
            d = (values[at] ^ value).bit_count()
            if d <= radius:
                found.append(at)
            low, high = d - radius, d + radius
            todo += [k for e, k in children[at].items() if low <= e <= high]
        return found


def spanning_links(values: list[int], radius: int = RADIUS) -> list[tuple[int, int]]:
    """Edges (later, earlier) by position that connect what is within the radius: a forest, so fewer than the values."""
    tree, parent, edges = BKTree(), list(range(len(values))), []

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    for k, value in enumerate(values):
        for near in tree.within(value, radius):
            a, b = root(k), root(near)
            if a != b:
                parent[max(a, b)] = min(a, b)
                edges.append((k, near))
        tree.add(value)
    return edges


def _block(i: int) -> Column:
    return F.shiftrightunsigned("fp", 16 * i).bitwiseAND(F.lit(0xFFFF))


def block_groups(prints: DataFrame) -> DataFrame:
    """Rows (id, fp, key), one for each pair of blocks: its number above the 32 bits of the two."""
    keys = (F.shiftleft(F.lit(k).cast("long"), 32).bitwiseOR(F.shiftleft(_block(a), 16)).bitwiseOR(_block(b)) for k, (a, b) in enumerate(PAIRS))
    return prints.select("id", "fp", F.explode(F.array(*keys)).alias("key"))


def split_groups(spread: DataFrame, most: int = MOST) -> DataFrame:
    """Rows (id, fp, key) with keys of their own for the parts of groups of more than ``most`` rows."""
    hot = checkpointed(spread.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("key", F.lit(True).alias("hot")))
    n = hot.count()
    if not n:
        return spread
    marked = spread.join(F.broadcast(hot) if n <= BROADCAST_KEYS else hot, "key", "left")
    pair = F.shiftrightunsigned("key", 32)
    others = [[i for i in range(4) if i not in p] for p in PAIRS]
    rest = F.coalesce(*(F.when(pair == k, F.shiftleft(_block(i), 16).bitwiseOR(_block(j))) for k, (i, j) in enumerate(others)))
    byte = lambda i: F.shiftrightunsigned("rest", 8 * i).bitwiseAND(F.lit(0xFF))
    parts_ = F.array(*(F.xxhash64("key", F.lit(k), byte(a), byte(b)) for k, (a, b) in enumerate(PAIRS)))
    return marked.withColumn("rest", rest).select("id", "fp", F.explode(F.when(F.col("hot"), parts_).otherwise(F.array("key"))).alias("key"))


def links(prints: DataFrame, radius: int = RADIUS, most: int = MOST) -> DataFrame:
    """Edges (u, v) of ids that connect the rows (id, fp), with distinct fp, whose fp differ in ``radius`` bits or fewer."""
    if radius > RADIUS:
        raise ValueError(f"four blocks find fingerprints within {RADIUS} bits, not {radius}")
    spread = split_groups(block_groups(prints), most)
    shard = spread.repartition(parts(prints.sparkSession), "key").sortWithinPartitions("key", "id")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def forest(keys: np.ndarray, ids: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
            cut = np.flatnonzero(keys[1:] != keys[:-1]) + 1
            cut = np.concatenate([[0], cut, [len(keys)]])
            u, v = [], []
            for lo, hi in zip(cut[:-1][np.diff(cut) > 1], cut[1:][np.diff(cut) > 1]):
                edges = spanning_links(fps[lo:hi].tolist(), radius)
                u += [ids[lo + a] for a, _ in edges]
                v += [ids[lo + b] for _, b in edges]
            return pa.record_batch({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

        for batch in batches:  # sorted by key; the last key of a batch may go on in the next
            new = [np.asarray(batch.column("key")), np.asarray(batch.column("id")), np.asarray(batch.column("fp")).view(np.uint64)]
            held = [np.concatenate(x) for x in zip(held, new)] if held else new
            if not len(held[0]):
                continue
            whole = int(np.searchsorted(held[0], held[0][-1]))
            if whole:
                yield forest(*(x[:whole] for x in held))
                held = [x[whole:] for x in held]
        if held and len(held[0]):
            yield forest(*held)

    return shard.mapInArrow(search, "u long, v long").distinct()


def grouped(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp and component_id, the smallest doc_id that links reach, for every document."""
    prints = checkpointed(with_fingerprints(docs))
    distinct = checkpointed(prints.groupBy("fp").agg(F.min("doc_id").alias("id")))
    found = components(links(distinct, radius))
    rep = distinct.join(found, distinct["id"] == found["node"], "left").select("fp", F.coalesce("component", "id").alias("component_id"))
    return prints.join(rep, "fp").select("doc_id", "fp", "component_id")


def deduplicated(docs: DataFrame, radius: int = RADIUS, grouper: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The documents with the smallest doc_id of their group, all columns as they were. ``grouper`` gives doc_id and
    component_id of documents with distinct ids, as ``grouped`` does unless another is given.

    Of rows that agree in doc_id and text one stays. Unlike texts of one doc_id are documents of their own, of which the one
    with the smaller text comes first; rows without a doc_id belong to no group and stay."""
    grouper = grouper or (lambda d: grouped(d, radius))
    named = docs.where("doc_id is not null")
    counts = named.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("ids")).first()
    if counts["n"] == counts["ids"]:
        gone = checkpointed(grouper(named)).where("doc_id != component_id").select("doc_id")
        return docs.join(gone.distinct(), "doc_id", "left_anti").select(*docs.columns)
    mark = "_" * (max(map(len, docs.columns)) + 1)  # names that no column has
    key = [F.col("doc_id").cast("long").alias("doc_id"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest")]
    # Numbers that rise with doc_id and text stand in for the ids.
    texts = named.select(F.col("doc_id").cast("long").alias("doc_id"), "text", key[1]).dropDuplicates(["doc_id", "digest"])
    texts = checkpointed(texts.orderBy("doc_id", "text", "digest").withColumn("number", F.monotonically_increasing_id()))
    groups = checkpointed(grouper(texts.select(F.col("number").alias("doc_id"), "text")))
    stay = groups.where("doc_id = component_id").select(F.col("doc_id").alias("number"))
    stay = texts.select("doc_id", "digest", "number").join(stay, "number", "left_semi").select(F.col("doc_id").alias(f"{mark}i"), F.col("digest").alias(f"{mark}d"))
    first = F.row_number().over(Window.partitionBy("doc_id", f"{mark}d").orderBy("doc_id"))  # cut to one in each task before the shuffle, too
    kept = named.withColumn(f"{mark}d", key[1]).withColumn(mark, first).where(F.col(mark) == 1).drop(mark)
    kept = kept.join(stay.withColumnRenamed(f"{mark}i", "doc_id"), ["doc_id", f"{mark}d"], "left_semi").select(*docs.columns)
    return kept.unionByName(docs.where("doc_id is null"))


def op4_bk_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = grouped(documents(spark, sf_dir))
    return got.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
