"""Hard-negative mining by branch-and-bound over ball trees.

Vectors are integers: a component x becomes floor(256 * x). Rows are spread over shards by a hash, so that neither a hot
label nor a hot vector fills one, and each shard has a ball tree. A node knows its centre, its radius and its range of
labels; by the centre's inner product with an anchor plus or minus the anchor's length times the radius it bounds the
scores of all rows below from above and below. A search leaves a node out if it holds no row of the wanted labels, if the
bounds are outside the window of scores, or if the upper one is strictly beneath the current k-th score. Anchors meet
every shard in blocks; of each shard at most k rows a question come back, and the best k of those are the answer.

Two searches follow each other: positives (same label, no window, k = 5), then for each anchor and positive the negatives
(another label, a window of scores that the positive's score sets, k = 3).

Scores are exact: products are made in float64 where every sum stays below 2**53, else in Python's integers, and what does
not fit a long is an error. Bounds have slack for rounding, so no row is left out that belongs to the answer.

Defined cases: rows without an id, label or vector, or with a component that is null or not finite, take no part; a
shorter vector counts as padded with zeros; rows that agree in id, label and vector are one row, and rows that share an
id alone are different rows, of equal scores the smaller vector first; an anchor is never its own positive; negative
scores have no window that a row could be in, and a score of 0 takes those of 0; an empty table, or one without anchors,
gives no rows; other columns, whatever their names, are ignored. Costs: rows are copied once for each block of 16,384 anchors, anchors once for
each shard (65,536 rows, or fewer to use all partitions).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpointed, parts

LEAF = 64
SHARD_ROWS, ANCHOR_BLOCK = 1 << 16, 1 << 14
POSITIVES, NEGATIVES = 5, 3
LOW_PERCENT, HIGH_PERCENT = 50, 95
_LEAST, _MOST = -(1 << 62), 1 << 62


def integers(rows: DataFrame, id_: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """id, label, q (array<bigint>) and key of the rows that take part."""
    v = F.col(f"`{vector}`")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    some = rows.where(F.col(f"`{id_}`").isNotNull() & F.col(f"`{label}`").isNotNull() & v.isNotNull()).where(finite)
    q = F.transform(v, lambda x: F.floor(x.cast("double") * 256))
    got = some.select(F.col(f"`{id_}`").cast("long").alias("id"), F.col(f"`{label}`").cast("long").alias("label"), q.alias("q"))
    return got.withColumn("key", F.xxhash64("label", "q"))


def matrix(lists: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of an integer list column; short ones end in zeros."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    wide = int(sizes.max(initial=0))
    if (sizes == wide).all():
        return flat.reshape(len(sizes), wide)
    out = np.zeros((len(sizes), wide), np.int64)
    out[np.arange(wide) < sizes[:, None]] = flat
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of a with those of b."""
    wide = min(a.shape[1], b.shape[1])
    a, b = a[:, :wide], b[:, :wide]
    if not wide or not len(a) or not len(b):
        return np.zeros((len(a), len(b)), np.int64)
    most = wide * max(abs(int(a.max())), abs(int(a.min()))) * max(abs(int(b.max())), abs(int(b.min())))
    if most < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    exact = a.astype(object) @ b.astype(object).T
    if exact.max() > _MOST or exact.min() < _LEAST:
        raise OverflowError("an inner product does not fit a long")
    return exact.astype(np.int64)


class Ball:
    """A node: rows lo to hi - 1 of the tree's order, and its two halves unless it is a leaf."""

    __slots__ = ("lo", "hi", "centre", "radius", "least", "most", "halves")


class BallTree:
    """Rows ordered so that each node's are consecutive. Labels that would fill leaves of their own are parted first; then
    rows are halved at the median along the line between two far ones."""

    def __init__(self, vectors: np.ndarray, labels: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(labels))
        self.leaf = leaf
        self._x, self._labels = vectors.astype(np.float64), labels
        self.root = self._node(0, len(labels)) if len(labels) else None
        del self._x, self._labels

    def _node(self, lo: int, hi: int) -> Ball:
        at = self.order[lo:hi]
        x, labels = self._x[at], self._labels[at]
        ball = Ball()
        ball.lo, ball.hi, ball.halves = lo, hi, ()
        ball.centre = x.mean(axis=0)
        away = np.sqrt(((x - ball.centre) ** 2).sum(axis=1))
        ball.radius, ball.least, ball.most = float(away.max()) * (1 + 1e-9) + 1e-6, labels.min(), labels.max()
        if hi - lo <= self.leaf:
            return ball
        kinds = len(np.unique(labels)) if ball.least != ball.most else 1
        if kinds > 1 and kinds * self.leaf <= hi - lo:
            by = labels
            middle = np.sort(labels)[len(labels) // 2]
            n = int((labels < middle).sum()) or int((labels <= middle).sum())
        else:
            one = x[int(away.argmax())]
            other = x[int(((x - one) ** 2).sum(axis=1).argmax())]
            by, n = x @ (other - one), len(at) // 2
        self.order[lo:hi] = at[np.argsort(by, kind="stable")]
        ball.halves = (self._node(lo, lo + n), self._node(lo + n, hi))
        return ball


class Search:
    """The best k rows of one tree for many questions. A question is an anchor with a window of scores."""

    def __init__(self, vectors, labels, ids, keys, k: int, same_label: bool, leaf: int = LEAF):
        self.tree = BallTree(vectors, labels, leaf)
        order = self.tree.order
        self.x, self.labels, self.ids, self.keys = vectors[order], labels[order], ids[order], keys[order]
        self.k, self.same, self.visited = k, same_label, 0

    def run(self, anchors, labels, ids, keys, of, low, high):
        """Scores, ids and keys of shape (questions, k), best first; _LEAST where there are fewer. ``of`` is the anchor of each
        question. Returns scores and the rows' places, -1 for none."""
        self.anchors, self.a_labels, self.a_ids, self.a_keys = anchors, labels, ids, keys
        self.float = anchors.astype(np.float64)
        self.length = np.sqrt((self.float**2).sum(axis=1))
        self.of, self.low, self.high = of, low, high
        self.score = np.full((len(of), self.k), _LEAST, np.int64)
        self.place = np.full((len(of), self.k), -1, np.int64)
        if self.tree.root is not None and len(of):
            self._visit(self.tree.root, np.arange(len(of)))
        return self.score, self.place

    def _visit(self, ball: Ball, asked: np.ndarray) -> None:
        label = self.a_labels[self.of[asked]]
        if self.same:
            asked = asked[(label >= ball.least) & (label <= ball.most)]
        elif ball.least == ball.most:
            asked = asked[label != ball.least]
        if not len(asked):
            return
        who, back = np.unique(self.of[asked], return_inverse=True)
        wide = min(self.float.shape[1], len(ball.centre))
        middle = self.float[who, :wide] @ ball.centre[:wide]
        reach = self.length[who] * ball.radius
        slack = 1e-6 + 1e-9 * (np.abs(middle) + reach)
        upper, lower = (middle + reach + slack)[back], (middle - reach - slack)[back]
        keep = (upper >= self.low[asked]) & (lower <= self.high[asked]) & (upper >= self.score[asked, -1])
        asked = asked[keep]
        if not len(asked):
            return
        if ball.halves:
            first, second = ball.halves
            if len(asked) and self._nearer(second, asked) > self._nearer(first, asked):
                first, second = second, first
            self._visit(first, asked)
            self._visit(second, asked)
            return
        self._leaf(ball, asked)

    def _nearer(self, ball: Ball, asked: np.ndarray) -> float:
        wide = min(self.float.shape[1], len(ball.centre))
        return float((self.float[self.of[asked], :wide] @ ball.centre[:wide]).mean())

    def _leaf(self, ball: Ball, asked: np.ndarray) -> None:
        at = slice(ball.lo, ball.hi)
        who, back = np.unique(self.of[asked], return_inverse=True)
        self.visited += len(asked) * (ball.hi - ball.lo)
        score = products(self.anchors[who], self.x[at])
        own = (self.a_ids[who][:, None] == self.ids[at]) & (self.a_keys[who][:, None] == self.keys[at])
        agree = self.a_labels[who][:, None] == self.labels[at]
        fits = (agree & ~own if self.same else ~agree)[back]
        score = score[back]
        fits &= (score >= self.low[asked][:, None]) & (score <= self.high[asked][:, None]) & (score >= self.score[asked, -1][:, None])
        some = fits.any(axis=1)
        if not some.any():
            return
        asked, score, fits = asked[some], np.where(fits[some], score[some], _LEAST), fits[some]
        score = np.concatenate([self.score[asked], score], axis=1)
        place = np.concatenate([self.place[asked], np.where(fits, np.arange(ball.lo, ball.hi), -1)], axis=1)
        order = np.lexsort((self.keys[place], self.ids[place], -score), axis=1)[:, : self.k]
        self.score[asked] = np.take_along_axis(score, order, axis=1)
        self.place[asked] = np.take_along_axis(place, order, axis=1)


_FOUND = "anchor_id long, anchor_key long, question long, score long, id long, key long"


def nearest(rows: DataFrame, questions: DataFrame, k: int, same_label: bool, shards: int, blocks: int, leaf: int = LEAF) -> DataFrame:
    """anchor_id, anchor_key, question, score, id, key and rank: the best k rows for each question, over all rows.

    rows: id, label, q, key. questions: the same of the anchors, and asked, an array of (question, low, high)."""

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([(c.split()[0], pa.int64()) for c in _FOUND.split(", ")])
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        column = lambda t, c: t.column(c).to_numpy()
        known = pd.DataFrame({"id": column(left, "id"), "key": column(left, "key")}).drop_duplicates()
        left = left.take(pa.array(known.index))
        found = Search(matrix(left.column("q")), column(left, "label"), column(left, "id"), column(left, "key"), k, same_label, leaf)
        asked = right.column("asked").combine_chunks()
        of = np.repeat(np.arange(right.num_rows), np.diff(asked.offsets.to_numpy()))
        each = asked.flatten()
        field = lambda n: each.field(n).to_numpy(zero_copy_only=False)
        ids, keys = column(right, "id"), column(right, "key")
        score, place = found.run(matrix(right.column("q")), column(right, "label"), ids, keys, of, field("low"), field("high"))
        q, at = np.nonzero(place >= 0)
        p = place[q, at]
        return pa.table([ids[of[q]], keys[of[q]], field("question")[q], score[q, at], found.ids[p], found.keys[p]], schema=schema)

    shard = F.pmod(F.xxhash64("id", F.lit(13)), F.lit(shards)).cast("int")
    block = F.pmod(F.xxhash64("id", F.lit(17)), F.lit(blocks)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    renamed = lambda df, *more: df.select(*(F.col(c).alias(c) for c in ("id", "label", "q", "key")), *more)  # noqa: E731  (both may stem from one table)
    left = renamed(rows, shard.alias("shard"), every(blocks).alias("block"))
    right = renamed(questions, F.col("asked").alias("asked"), block.alias("block"), every(shards).alias("shard"))
    got = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(search, _FOUND)
    place = F.row_number().over(Window.partitionBy("anchor_id", "anchor_key", "question").orderBy(F.desc("score"), "id", "key"))
    return got.withColumn("rank", place).where(F.col("rank") <= k)


def hard_negatives(
    rows: DataFrame, anchors: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low_percent: int = LOW_PERCENT, high_percent: int = HIGH_PERCENT, shard_rows: int = SHARD_ROWS, anchor_block: int = ANCHOR_BLOCK, leaf: int = LEAF
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score. rows: id, label, q and key, as ``integers``
    gives them; anchors: which of them ask."""
    chosen = rows.where(anchors)
    n = rows.agg(F.count(F.lit(1)).alias("rows"), F.count_if(anchors).alias("anchors")).first()
    shards = max(parts(rows.sparkSession), -(-n["rows"] // shard_rows))
    blocks = max(1, -(-n["anchors"] // anchor_block))
    chosen = chosen.dropDuplicates(["id", "key"])
    anyone = F.array(F.struct(F.lit(0).cast("long").alias("question"), F.lit(_LEAST).alias("low"), F.lit(_MOST).alias("high")))
    first = nearest(rows, chosen.withColumn("asked", anyone), positives, True, shards, blocks, leaf)
    # A window of whole scores: 100 * negative between low_percent * positive and high_percent * positive.
    low = F.ceil(F.col("score") * low_percent / F.lit(100).cast("decimal(3,0)")).cast("long")
    high = F.floor(F.col("score") * high_percent / F.lit(100).cast("decimal(3,0)")).cast("long")
    # ``positives`` rows a group; written, as both the second search and its result need them.
    few = first.groupBy("anchor_id", "anchor_key").agg(
        F.collect_list(F.struct(F.col("rank").cast("long").alias("question"), low.alias("low"), high.alias("high"))).alias("asked"),
        F.collect_list(F.struct("rank", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))).alias("_positives"),
    )
    few = checkpointed(few)
    asking = chosen.join(few.select(F.col("anchor_id").alias("id"), F.col("anchor_key").alias("key"), "asked"), ["id", "key"])
    second = nearest(rows, asking, negatives, False, shards, blocks, leaf)
    named = few.select("anchor_id", "anchor_key", F.inline("_positives")).withColumnRenamed("rank", "question")
    got = second.join(named, ["anchor_id", "anchor_key", "question"])
    return got.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op13_ball_tree_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = integers(rows.withColumn("label", label))
    return hard_negatives(rows, F.col("id") % 50 == 0)
