"""As-of joins as one sorted pass: rows of both sides lie in one stream by time, and the last value seen goes along.

A key's stream is split by ranges of time, at approximate quantiles of all times, so that no task holds a key, however many
of the rows it has. What a range hands to the one before it is one row: the first time among its others. Ranges are
summed up with partial sums, so these rows are as few as keys times ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGES = 64


def _ticks(ts: str, df: DataFrame) -> Column:
    """Times as numbers that ``percentile_approx`` takes; other ordered numbers as they are."""
    return F.unix_micros(F.col(ts).cast("timestamp")) if df.schema[ts].dataType.typeName().startswith(("timestamp", "date")) else F.col(ts)


def next_after(starts: DataFrame, others: DataFrame, by: list[str], ts: str = "ts", ranges: int = RANGES) -> DataFrame:
    """Each row of ``starts`` with next_ts, the first strictly later time among ``others`` with the same keys, or null.

    Null keys are equal to each other, as in a grouping. A start without a time has no next one; others without a time
    do not count. Equal starts stay as they are. Time grows with the rows (and the sort), whatever the keys."""
    kind = starts.schema[ts].dataType
    rest = [c for c in starts.columns if c not in (*by, ts)]
    # The columns of starts travel as one struct, so that none clashes with the names used here.
    left = starts.select(F.struct(*by).alias("_k"), _ticks(ts, starts).alias("_t"), F.col(ts).alias("_ts"), F.lit(None).cast(kind).alias("_other"), F.struct(F.lit(True).alias("is"), *rest).alias("_row"))
    right = others.select(F.struct(*by).alias("_k"), _ticks(ts, others).alias("_t"), F.col(ts).alias("_ts"), F.col(ts).cast(kind).alias("_other")).where("_ts is not null").distinct()
    both = left.unionByName(right, allowMissingColumns=True)
    cuts = both.agg(F.percentile_approx("_t", [k / ranges for k in range(1, ranges)], F.lit(1000)).alias("_cuts"))  # one row
    both = both.crossJoin(F.broadcast(cuts)).withColumn("_range", F.coalesce(F.size(F.filter("_cuts", lambda x: x < F.col("_t"))), F.lit(0))).drop("_cuts")
    # What later ranges of a key begin with; a struct key equals one with the same nulls.
    later = Window.partitionBy("_k").orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1)
    handed = both.groupBy("_k", "_range").agg(F.min("_other").alias("_first")).select("_k", "_range", F.min("_first").over(later).alias("_handed"))
    # Downwards in time, of one time the starts before the others: what has been seen is strictly later.
    seen = Window.partitionBy("_k", "_range").orderBy(F.desc("_t"), F.col("_other").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = both.withColumn("_seen", F.min("_other").over(seen)).where("_row is not null")
    got = inside.join(handed, ["_k", "_range"], "left")
    near = F.when(F.col("_ts").isNotNull(), F.coalesce("_seen", "_handed"))
    own = {c: F.col(f"_k.`{c}`") for c in by} | {ts: F.col("_ts")} | {c: F.col(f"_row.`{c}`") for c in rest}
    return got.select(*(own[c].alias(c) for c in starts.columns), near.alias("next_ts"))
