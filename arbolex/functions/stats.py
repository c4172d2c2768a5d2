"""Distribution summaries with floor-index percentiles, buckets, shares and top-k counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


FINE = 4096  # equal ranges that a coarse one is refined by


def _coarse(v: Column) -> Column:
    """A number that never falls as the value grows, and takes some thousand values: 64 for each doubling."""
    d = v.cast("double")
    size = F.least(F.floor(F.log2(F.abs(d)) * 64), F.lit(100_000)) + 200_000  # the smallest double has -68,736
    return F.when(F.isnan(d), F.lit(10**7)).when(d > 0, size).when(d < 0, -size).otherwise(F.lit(0)).cast("long")


def _fine(v: Column) -> Column:
    """Which of FINE equal ranges between lo and hi a value is in; it never falls as the value grows."""
    wide = F.col("hi").cast("double") - F.col("lo").cast("double")
    return F.when(wide > 0, F.floor((v.cast("double") - F.col("lo").cast("double")) / wide * FINE)).otherwise(F.lit(0)).cast("long")


def _placed(hist: DataFrame, group: list[str], order: str) -> DataFrame:
    """Adds _before, how many of the group's rows stand before a range, and leaves of its wanted places those within it."""
    upto = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = F.sum("c").over(upto) - F.col("c") + F.col("_base")
    hist = hist.withColumn("_before", before)
    mine = F.filter("_places", lambda x: (x >= F.col("_before")) & (x < F.col("_before") + F.col("c")))
    return hist.withColumn("_places", mine).where(F.size("_places") > 0)


def percentiles(df: DataFrame, value: str, by: list[str], percents: tuple[int, ...]) -> DataFrame:
    """by, n, min, max, sum and one column a percent, p50 and so on: the value at place min(floor(p / 100 * n), n - 1) of a
    group's sorted values, exact. Nulls do not count.

    Histograms are refined until the places are found: rows are counted by coarse ranges of values; of those that hold a
    wanted place the rows are counted by fine ranges; of those by value, which are sorted. Counts are summed before each shuffle
    and no rows are joined but with the few wanted ranges, so that no task holds a group, however large."""
    rows = df.where(F.col(value).isNotNull()).select(F.struct(*by).alias("_k"), F.col(value).alias("_v")).withColumn("_a", _coarse(F.col("_v")))
    counted = lambda r, *more: r.agg(F.count(F.lit(1)).alias("c"), F.min("_v").alias("lo"), F.max("_v").alias("hi"), *more)
    coarse = counted(rows.groupBy("_k", "_a"), F.sum("_v").alias("s"))
    total = coarse.groupBy("_k").agg(F.sum("c").alias("n"), F.min("lo").alias("min"), F.max("hi").alias("max"), F.sum("s").alias("sum"))
    n = F.sum("c").over(Window.partitionBy("_k"))  # some thousand ranges a group at most
    place = lambda n, p: F.least(F.floor(n * p / 100), n - 1).cast("long")
    coarse = coarse.withColumn("_places", F.array(*(place(n, p) for p in percents))).withColumn("_base", F.lit(0))
    first = _placed(coarse, ["_k"], "_a").select("_k", "_a", "lo", "hi", "_before", "_places")
    fine = rows.join(first, ["_k", "_a"]).withColumn("_b", _fine(F.col("_v"))).groupBy("_k", "_a", "_b")
    fine = counted(fine, F.first("_before").alias("_base"), F.first("_places").alias("_places"))
    second = _placed(fine, ["_k", "_a"], "_b").select("_k", "_a", "lo", "hi", "_before", "_places")
    last = rows.join(second, ["_k", "_a"]).where((F.col("_v") >= F.col("lo")) & (F.col("_v") <= F.col("hi"))).groupBy("_k", "lo", "_v")
    last = last.agg(F.count(F.lit(1)).alias("c"), F.first("_before").alias("_base"), F.first("_places").alias("_places"))
    found = _placed(last, ["_k", "lo"], "_v").select("_k", "_v", F.explode(F.array_distinct("_places")).alias("_at"))
    found = found.groupBy("_k").agg(F.map_from_entries(F.collect_list(F.struct("_at", "_v"))).alias("_m"))  # one for each percent
    got = total.join(found, "_k")
    return got.select(*(F.col(f"_k.`{c}`").alias(c) for c in by), "n", "min", "max", "sum", *(F.element_at("_m", place(F.col("n"), p)).alias(f"p{p}") for p in percents))


def describe(df: DataFrame, value: str, by: list[str], percents: tuple[int, ...] = (25, 50, 75, 90, 95, 99)) -> DataFrame:
    """count, min, percentiles, max and mean (2 places) of each group."""
    got = percentiles(df, value, by, percents)
    return got.select(*by, "n", "min", *(f"p{p}" for p in percents), "max", F.round(F.col("sum") / F.col("n"), 2).alias("mean"))


def bucket(value: Column, edges: tuple[int, ...] = (0, 25, 50, 100, 200)) -> Column:
    """'0', '1-25', ..., '201+': which range a count is in."""
    out = F.lit(f"{edges[-1] + 1}+")
    for lo, hi in reversed(list(zip(edges[:-1], edges[1:]))):
        out = F.when(value <= hi, F.lit(f"{lo + 1}-{hi}")).otherwise(out)
    return F.when(value <= edges[0], F.lit(str(edges[0]))).otherwise(out)


def bucket_shares(df: DataFrame, value: str) -> DataFrame:
    """bucket, n and percent (1 place) of all rows."""
    counts = df.groupBy(bucket(F.col(value)).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy())  # one row a bucket
    return counts.withColumn("percent", F.round(100 * F.col("n") / total, 1))


def top_counts(df: DataFrame, key: str | Column, first: str | Column, k: int) -> DataFrame:
    """The k most frequent keys; of equal counts the one seen first leads."""
    key = F.col(key) if isinstance(key, str) else key
    counts = df.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n"), F.min(first).alias("first"))
    return counts.orderBy(F.desc("n"), "first", "key").limit(k).select("key", "n")


def share_within(df: DataFrame, value: str, cap: int) -> DataFrame:
    """The fraction of rows that a cap leaves whole."""
    return df.agg(F.round(F.avg((F.col(value) <= cap).cast("int")), 4).alias("share"))


def drawn(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """n random rows, the same ones for one seed however the rows are spread; only n rows leave each task."""
    return df.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), key).limit(n)


def counts_by(df: DataFrame, *by: str) -> DataFrame:
    """How many rows each combination of keys has."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def grand_total(counts: DataFrame, value: str = "count") -> DataFrame:
    """One row: how many rows, and the sum of their counts."""
    return counts.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(value), F.lit(0)).cast("long").alias("total"))


def variants_by_base(bases: DataFrame, variants: DataFrame, key: str, base: str) -> DataFrame:
    """Every base with the number of its variants, 0 where it has none."""
    n = variants.where(F.col(base).isNotNull()).groupBy(F.col(base).alias(key)).agg(F.count(F.lit(1)).alias("n"))
    return bases.select(key).join(n, key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n"))


def most_counted(keys: DataFrame, rows: DataFrame, key: str, k: int = 25) -> DataFrame:
    """The k keys with the most rows, those without any included; ties go to the smaller key."""
    return variants_by_base(keys, rows, key, key).orderBy(F.desc("n"), key).limit(k)


def prefix_counts(codes: DataFrame, code: str, sizes: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """size, prefix and n: how many codes begin with each prefix of each size."""
    rows = codes.select(code, F.explode(F.array(*(F.lit(n) for n in sizes))).alias("size"))
    return rows.groupBy("size", F.expr(f"substring(`{code}`, 1, size)").alias("prefix")).agg(F.count(F.lit(1)).alias("n"))


def largest_prefixes(counts: DataFrame, k: int = 5) -> DataFrame:
    """The k commonest prefixes of each size."""
    place = F.row_number().over(Window.partitionBy("size").orderBy(F.desc("n"), "prefix"))
    return counts.withColumn("_place", place).where(F.col("_place") <= k).drop("_place")


def covered_share(rows: DataFrame, key: str, all_keys: DataFrame, places: int = 2) -> DataFrame:
    """One row: how many distinct keys the rows hold, and what percent of all keys that is."""
    n = all_keys.agg(F.count(F.lit(1)).alias("_n"))  # one row
    return rows.agg(F.count_distinct(key).alias("covered")).crossJoin(F.broadcast(n)).select("covered", F.round(100 * F.col("covered") / F.col("_n"), places).alias("percent"))


def split_counts(rows: DataFrame, flag: Column, text: Column, *by: str) -> DataFrame:
    """n, how many rows have the flag (flagged) and how many not (plain), and the mean length of a text (4 places)."""
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(flag).alias("flagged"), F.count_if(~flag).alias("plain"), F.round(F.avg(F.length(text)), 4).alias("mean_length"))
