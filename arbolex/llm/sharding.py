"""Sharding with sampled splitters.

Documents are ordered by the key (hash of the text, doc_id). A size-weighted sample of the keys gives the splitters of
many ranges, records are range-partitioned by them, ranges that turn out overfull are subdivided with a denser sample of
their own, and 40 shards of nearly equal bytes are cut from the ranges in key order.

Only (doc_id, size, crc, hash) is moved, never the text. Equal texts stand next to each other in key order, so a group
of copies stays in one shard, or in consecutive ones where it is larger than a shard; because doc_id ends the key, no
group is too hot for a range. The driver holds the sample and one row a range, both bounded by parameters.

Defined cases: a null text has size 16 and CRC 0; an empty table gives no rows; repeated rows are kept as they are;
other columns, whatever their names, are ignored; with fewer documents than shards some shards stay empty.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpointed, documents

SHARDS = 40
ROWS_A_RANGE = 100_000
MIN_RANGES, MAX_RANGES = 160, 20_000
SAMPLES_A_RANGE = 24
OVERFULL = 2.0
_SIGN = 1 << 63
NO_ID = -(1 << 63)  # rows without a doc_id come first


def _keys(h, doc_id, row) -> np.ndarray:
    """24 bytes that sort as (h, doc_id, row)."""
    out = np.empty((len(h), 3), ">u8")
    for k, x in enumerate((h, doc_id, row)):
        out[:, k] = np.asarray(x, np.int64).astype(np.uint64) + np.uint64(_SIGN)
    return out.view("S24").ravel()


def _ranged(base: DataFrame, splitters: np.ndarray) -> DataFrame:
    """Adds range_id: how many splitters are at or below the row's key."""
    cuts = base.sparkSession.sparkContext.broadcast(splitters)  # at most MAX_RANGES * 2 keys of 24 bytes

    @F.pandas_udf("int")
    def range_of(h: pd.Series, doc_id: pd.Series, row: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts.value, _keys(h, doc_id, row), "right").astype(np.int32))

    return base.withColumn("range_id", range_of("h", F.coalesce("doc_id", F.lit(NO_ID)), "row"))  # a null would make floats of them


def _sample(rows: DataFrame, rate: float, seed: int) -> np.ndarray:
    """Sorted keys of a sample that takes each row with a chance of rate times its size; repeatable, as it is by hash."""
    chance = F.pmod(F.xxhash64("doc_id", "h", "row", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    got = rows.where(chance < F.col("size") * rate).select("h", F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), "row").toArrow()
    return np.sort(_keys(*(np.asarray(got[c], np.int64) for c in ("h", "doc_id", "row"))))


def _quantiles(keys: np.ndarray, ranges: int) -> np.ndarray:
    if not len(keys) or ranges < 2:
        return keys[:0]
    return np.unique(keys[np.minimum(np.arange(1, ranges) * len(keys) // ranges, len(keys) - 1)])


def _splitters(base: DataFrame, n: int, total: int) -> np.ndarray:
    """Quantile boundaries of a sample; ranges over twice the mean are subdivided, a few times if need be."""
    ranges = int(min(MAX_RANGES, max(MIN_RANGES, n // ROWS_A_RANGE)))
    rate = SAMPLES_A_RANGE * ranges / total
    cuts = _quantiles(_sample(base, rate, 0), ranges)
    for again in range(1, 4):
        full = _ranged(base, cuts).groupBy("range_id").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"))
        over = full.where((F.col("size") > OVERFULL * total / ranges) & (F.col("n") > 1)).limit(ranges).collect()
        if not over:
            break
        ids = [r["range_id"] for r in over]
        dense = _sample(_ranged(base, cuts).where(F.col("range_id").isin(ids)), rate * 8, again)
        at = np.searchsorted(cuts, dense, "right")
        new = [_quantiles(dense[at == r["range_id"]], int(np.ceil(r["size"] * ranges / total)) + 1) for r in over]
        more = np.unique(np.concatenate([cuts, *new]))
        if len(more) == len(cuts):
            break
        cuts = more
    return cuts


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot, range_id: every document once, in shards of nearly equal bytes."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = checkpointed(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.octet_length(text) + 16).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(text).alias("h"),
            F.monotonically_increasing_id().alias("row"),  # so that repeats of one row are not all in one range
        )
    )
    got = base.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("size")).first()
    n, total = got["n"], max(1, got["size"])
    ranged = _ranged(base, _splitters(base, n, total))
    # One row a range: what lies before it. The window has no partitions, but its rows are ranges, at most 2 * MAX_RANGES.
    sums = ranged.groupBy("range_id").agg(F.sum("size").alias("s"), F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("range_id").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("range_id", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("size_before"))
    inside = Window.partitionBy("range_id").orderBy("h", "doc_id", "row").rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.withColumn("pos", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(F.broadcast(sums), "range_id")
    # The middle of a document decides, so that a long one goes where more of it lies.
    middle = (F.col("pos") + F.col("size_before") + F.col("size") / 2) * shards / total
    placed = placed.withColumn("shard", F.least(F.floor(middle), F.lit(shards - 1)).cast("int"))
    cell = Window.partitionBy("range_id", "shard").orderBy("h", "doc_id", "row")
    placed = placed.withColumn("k", F.row_number().over(cell) - 1)
    cells = placed.groupBy("shard", "range_id").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("shard").orderBy("range_id").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("shard", "range_id", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    return placed.join(F.broadcast(cells), ["shard", "range_id"]).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("base") + F.col("k")).cast("long").alias("slot"), "range_id"
    )


def op7_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(documents(spark, sf_dir)).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "range_id"
    )
