"""Tables that are changed by key without being written anew: a base in ranges of keys, deltas, and compaction of ranges.

``path`` holds parts/(name), Parquet folders that never change, and heads/(number), one small JSON table each that names the parts
that are current: of each range its base part, its bounds, and the deltas since. A change writes one part with the changed
rows and a new head; readers that hold the former head go on reading it. A read joins the latest row of each changed key over
the base, whose unchanged rows pass by a broadcast where the deltas are small. Compaction rewrites only the ranges that
deltas touch. One writer at a time; a change that is cut off leaves the former head in force.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RANGES = 64
_HEAD = "kind string, part string, number int, low string, high string"


@dataclass
class Head:
    """Base parts with the bounds of their keys (as text, low included and high not; null for open), and deltas in order."""

    number: int
    base: list[tuple[str, int, str | None, str | None]]  # part, range, low, high
    deltas: list[str]


def _folders(spark: SparkSession, path: str) -> list[str]:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    done = lambda p: fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))
    return [s.getPath().getName() for s in fs.listStatus(place) if done(s.getPath())] if fs.exists(place) else []


def head(spark: SparkSession, path: str) -> Head | None:
    """The newest whole head, or None where there is no table."""
    numbers = [int(n) for n in _folders(spark, f"{path}/heads")]
    if not numbers:
        return None
    rows = spark.read.schema(_HEAD).json(f"{path}/heads/{max(numbers)}").collect()  # ranges and deltas, some hundred
    base = sorted((r["part"], r["number"], r["low"], r["high"]) for r in rows if r["kind"] == "base")
    return Head(max(numbers), sorted(base, key=lambda b: b[1]), [r["part"] for r in sorted(rows, key=lambda r: r["number"]) if r["kind"] == "delta"])


def _put_head(spark: SparkSession, path: str, h: Head) -> None:
    rows = [("base", *b) for b in h.base] + [("delta", d, i, None, None) for i, d in enumerate(h.deltas)]
    spark.createDataFrame(rows, _HEAD).coalesce(1).write.json(f"{path}/heads/{h.number}")


def _part(df: DataFrame, path: str, *sort: str) -> str:
    name = uuid.uuid4().hex
    (df.sortWithinPartitions(*sort) if sort else df).write.parquet(f"{path}/parts/{name}")
    return name


def create(df: DataFrame, path: str, key: list[str], ranges: int = RANGES) -> None:
    """Writes a table anew. Its ranges are of about equal numbers of rows, by the first key column as text."""
    spark = df.sparkSession
    first = F.col(key[0]).cast("string")
    before = head(spark, path)
    staged = _part(df, path)
    rows = spark.read.parquet(f"{path}/parts/{staged}")
    # Bounds from a bounded sample: they only decide how even the ranges are.
    n = rows.count()
    drawn = sorted(r[0] for r in rows.select(first.alias("k")).where("k is not null").sample(min(1.0, 100 * ranges / max(n, 1)), seed=1).limit(200 * ranges).collect())
    bounds = sorted({drawn[len(drawn) * i // ranges] for i in range(1, ranges)} - {""}) if drawn else []  # nulls and '' come first
    # All ranges begin in one part, sorted by key; one that is compacted later gets a part of its own.
    whole = _part(rows.withColumn("_range", _range_of(first, bounds)).repartition("_range").drop("_range"), path, *key)
    _drop(spark, [f"{path}/parts/{staged}"])
    base = [(whole, i, low, high) for i, (low, high) in enumerate(zip([None, *bounds], [*bounds, None]))]
    _put_head(spark, path, Head(before.number + 1 if before else 0, base, []))


def _range_of(first: Column, bounds: list[str]) -> Column:
    return F.size(F.filter(F.array(*(F.lit(b) for b in bounds)).cast("array<string>"), lambda b: b <= F.coalesce(first, F.lit(""))))


def _drop(spark: SparkSession, paths: list[str]) -> None:
    for p in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(p)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def _within(key: list[str], low: str | None, high: str | None) -> Column:
    """Rows of one range; null keys are in the first."""
    k = F.col(key[0]).cast("string")
    lower = F.lit(True) if low is None else k >= F.lit(low)
    upper = F.lit(True) if high is None else (k < F.lit(high)) | (k.isNull() if low is None else F.lit(False))
    return lower & upper


def _base(spark: SparkSession, path: str, h: Head, key: list[str]) -> DataFrame:
    parts: dict[str, list[Column]] = {}
    for name, _, low, high in h.base:
        parts.setdefault(name, []).append(_within(key, low, high))
    read = lambda name: spark.read.parquet(f"{path}/parts/{name}")
    whole = len(parts) == 1
    return reduce(DataFrame.unionByName, [read(n) if whole else read(n).where(reduce(lambda a, b: a | b, w)) for n, w in parts.items()])


def changes(spark: SparkSession, path: str, h: Head, key: list[str]) -> DataFrame | None:
    """The latest row of each key that deltas changed."""
    if not h.deltas:
        return None
    rows = reduce(DataFrame.unionByName, [spark.read.parquet(f"{path}/parts/{name}").withColumn("_at", F.lit(i)) for i, name in enumerate(h.deltas)])
    rest = [c for c in rows.columns if c not in (*key, "_at")]
    return rows.groupBy(*key).agg(F.max_by(F.struct(F.lit(1).alias("_one"), *rest), "_at").alias("_r")).select(*key, *(F.col(f"_r.`{c}`").alias(c) for c in rest))


def read(spark: SparkSession, path: str, key: list[str]) -> DataFrame:
    """The table as it is now."""
    h = head(spark, path)
    if h is None:
        raise FileNotFoundError(f"no table at {path}")
    base, changed = _base(spark, path, h, key), changes(spark, path, h, key)
    if changed is None:
        return base
    same = reduce(lambda a, b: a & b, (F.col(f"o.`{k}`").eqNullSafe(F.col(f"n.`{k}`")) for k in key))
    return base.alias("o").join(changed.select(*key).alias("n"), same, "left_anti").unionByName(changed.select(*base.columns))


def merge(spark: SparkSession, path: str, new: DataFrame, key: list[str]) -> None:
    """Replaces or adds rows by key: writes these rows only. Of several new rows with one key, any one stays."""
    h = head(spark, path)
    if h is None:
        return create(new.dropDuplicates(key), path, key)
    name = _part(new.dropDuplicates(key), path, *key)
    _put_head(spark, path, Head(h.number + 1, h.base, [*h.deltas, name]))


def compact(spark: SparkSession, path: str, key: list[str]) -> list[int]:
    """Folds the deltas into the ranges that they touch, and says which. Other ranges stay as they are written."""
    h = head(spark, path)
    if h is None or not h.deltas:
        return []
    changed = changes(spark, path, h, key)
    bounds = [low for _, _, low, _ in h.base if low is not None]
    touched = sorted(r[0] for r in changed.select(_range_of(F.col(key[0]).cast("string"), bounds).alias("r")).distinct().collect())
    now = read(spark, path, key)
    one = F.lit(False)
    for _, i, low, high in h.base:
        if i in touched:
            one = one | _within(key, low, high)
    name = _part(now.where(one).repartitionByRange(*key), path, *key)
    _put_head(spark, path, Head(h.number + 1, [(name if i in touched else p, i, low, high) for p, i, low, high in h.base], []))
    return touched


def cleaned(spark: SparkSession, path: str, keep: int = 2) -> None:
    """Deletes heads but the last ``keep``, and the parts that none of them names. Readers of older heads must be done."""
    numbers = sorted(int(n) for n in _folders(spark, f"{path}/heads"))
    kept: set[str] = set()
    for n in numbers[-keep:]:
        kept |= {r["part"] for r in spark.read.schema(_HEAD).json(f"{path}/heads/{n}").collect()}
    _drop(spark, [f"{path}/heads/{n}" for n in numbers[:-keep]])
    _drop(spark, [f"{path}/parts/{p}" for p in _folders(spark, f"{path}/parts") if p not in kept])
