"""Reading the dumps and building the store's tables.

Line files are read with Spark's text source, gzip included. The order of lines is kept as ``ord`` (file name, then
place), since some rules take the last line or the first stored label.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arbolex.functions import scalars
from arbolex.operators import hierarchy


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, recursiveFileLookup=True).select("value", F.url_decode(F.col("_metadata.file_path")).alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))


def codes(spark: SparkSession, path: str) -> DataFrame:
    """notation: one code a line, trimmed, without blank lines."""
    return spark.read.text(path).select(F.trim("value").alias("notation")).where("notation != ''")


def _pairs(lines: DataFrame) -> DataFrame:
    """lang, key, text, ord, file from 'key|text' lines, split at the first bar; lines with an empty side are dropped."""
    split = F.split("value", r"\|", 2)
    rows = lines.where(F.contains("value", F.lit("|"))).select(
        F.regexp_extract("file", r"/([^/]+)/[^/]+$", 1).alias("lang"),
        F.trim(split[0]).alias("key"),
        F.trim(split[1]).alias("text"),
        F.struct("file", "block", "line").alias("ord"),
        F.regexp_extract("file", r"([^/]+)$", 1).alias("name"),
    )
    return rows.where("key != '' and text != ''")


def labels(spark: SparkSession, path: str) -> DataFrame:
    """notation, lang, text from txt files; the last line of a code and language counts."""
    rows = _pairs(_lines(spark, path)).where(F.col("name").startswith("txt_") & ~F.contains("name", F.lit("_keys")))
    return rows.groupBy(F.col("key").alias("notation"), "lang").agg(F.max_by("text", "ord").alias("text"))


def key_labels(spark: SparkSession, path: str) -> DataFrame:
    """key_id, lang, text from the key files."""
    rows = _pairs(_lines(spark, path)).where(F.contains("name", F.lit("_keys")))
    return rows.groupBy(F.col("key").alias("key_id"), "lang").agg(F.max_by("text", "ord").alias("text"))


def keywords(spark: SparkSession, path: str) -> DataFrame:
    """notation, lang, keyword, ord: order and duplicates are kept, known misspellings mended."""
    rows = _pairs(_lines(spark, path)).where(F.col("name").startswith("kw_"))
    return rows.select(F.col("key").alias("notation"), "lang", scalars.fixed_keyword(F.col("lang"), F.col("text")).alias("keyword"), "ord")


def count_rows(spark: SparkSession, path: str) -> DataFrame:
    """collection_id, notation, count, ord from '<id>-counts.csv' files, quoted cells included; header, short rows and
    counts below 1 are dropped."""
    rows = _lines(spark, path).where(F.col("file").rlike(r"-counts\.csv$"))
    cells = F.from_csv("value", "notation string, count string", {"quote": '"', "escape": '"'})
    rows = rows.select(
        F.regexp_extract("file", r"([^/]+)-counts\.csv$", 1).alias("collection_id"),
        F.trim(cells["notation"]).alias("notation"),
        F.trim(cells["count"]).try_cast("int").alias("count"),
        F.struct("file", "block", "line").alias("ord"),
    )
    return rows.where("count > 0 and notation != ''")


def last_counts(rows: DataFrame) -> DataFrame:
    """collection_id, notation, count: the last row of a code counts."""
    return rows.groupBy("collection_id", "notation").agg(F.max_by("count", "ord").alias("count"))


def collection_counts(spark: SparkSession, path: str) -> DataFrame:
    return last_counts(count_rows(spark, path))


def collection_info(rows: DataFrame, labels_: dict[str, str] | None = None, templates: dict[str, str] | None = None, as_of: str | None = None) -> DataFrame:
    """A row for each collection: its label, from the given ones or made of its id, and its number of rows as read."""
    from_ = lambda given: F.create_map(*(F.lit(x) for kv in (given or {"": ""}).items() for x in kv))[F.col("collection_id")]
    got = rows.groupBy("collection_id").agg(F.count(F.lit(1)).cast("int").alias("total_notations"))
    return got.select("collection_id", F.coalesce(from_(labels_), scalars.title_label(F.col("collection_id"))).alias("label"), F.lit(as_of).cast("string").alias("counts_as_of"), "total_notations", from_(templates).alias("search_url_template"))


def structure(raw: DataFrame) -> DataFrame:
    """notations from raw nodes (notation, path, children, refs, base, key, modifiers): base and key only where a code
    carries a modifier, children made of modifiers or without placeholders, the path without the code itself."""
    n = F.col("notation")
    keyed = scalars.is_modified(n)
    return raw.select(
        n,
        F.lower(n).alias("notation_lc"),
        hierarchy.path_of(n, F.col("path")).alias("path"),
        hierarchy.children_of(n, F.col("children"), F.col("modifiers")).alias("children"),
        "refs",
        F.when(keyed, F.coalesce("base", scalars.without_modifier(n))).alias("base_notation"),
        F.when(keyed, scalars.modifier_id(F.col("key"))).alias("key_id"),
        keyed.alias("is_key_expanded"),
        F.when(keyed, F.col("key")).alias("key_source"),  # of use while labels are composed
    )


def composed_labels(notations: DataFrame, base: DataFrame, keys: DataFrame) -> DataFrame:
    """Labels of codes with modifiers: the base's label and the key's, '{base} (+ {key})'; without a base none. A key is
    known by its whole id (``key_source``), as families of keys share the numbers of theirs."""
    rows = notations.where("is_key_expanded").select("notation", scalars.without_modifier(F.col("notation")).alias("_base"), F.col("key_source").alias("_key"))
    rows = rows.join(base.withColumnRenamed("notation", "_base"), "_base")
    keyed = keys.select(F.col("key_id").alias("_key"), "lang", F.col("text").alias("_ktext"))
    return rows.join(keyed, ["_key", "lang"], "left").select("notation", "lang", scalars.composed_label(F.col("text"), F.col("_ktext")).alias("text"))


def ordered(df: DataFrame, *by: str | Column) -> DataFrame:
    """Adds ord, a number that follows the given order; it stands for the place in storage."""
    return df.orderBy(*by).withColumn("ord", F.monotonically_increasing_id())


def latest(df: DataFrame, key: list[str], order: str) -> DataFrame:
    """Upsert: the last row of each key. One aggregation; no window, no sort."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*key, *(F.col(f"_r.{c}").alias(c) for c in rest))


def added(old: DataFrame, new: DataFrame, key: list[str], order: str) -> DataFrame:
    """Insert or ignore: the old rows, and of the new ones the first of each key that is not among them."""
    rest = [c for c in new.columns if c not in key]
    first = new.groupBy(*key).agg(F.min_by(F.struct(*rest), order).alias("_r")).select(*key, *(F.col(f"_r.{c}").alias(c) for c in rest))
    return old.unionByName(first.join(old.select(*key), key, "left_anti"))


def replay(spark: SparkSession, path: str) -> DataFrame:
    """tool, input from 'tool<TAB>json' lines; comments and lines whose second part is no JSON are skipped."""
    rows = spark.read.text(path).where(~F.col("value").startswith("#") & F.contains("value", F.lit("\t")))
    split = F.split("value", "\t", 2)
    return rows.select(F.trim(split[0]).alias("tool"), F.trim(split[1]).alias("input")).where(F.try_parse_json("input").isNotNull())


def composite_text(notations: DataFrame, texts: DataFrame, words: DataFrame) -> DataFrame:
    """notation and text for embedding: labels in en and nl, keywords of both, and the labelled path; base codes only, and
    none without a label or keyword."""
    base = notations.where("not is_key_expanded").select("notation", "path")
    by = lambda lang: texts.where(F.col("lang") == lang).groupBy("notation").agg(F.min_by("text", "ord").alias(lang))
    kw = words.where(F.col("lang").isin("en", "nl")).groupBy("notation").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("lang", "ord", "keyword"))), lambda x: x["keyword"])).alias("kw"))
    steps = base.select("notation", F.posexplode("path").alias("i", "step"))
    names = texts.groupBy(F.col("notation").alias("step")).agg(F.min_by("text", F.when(F.col("lang") == "en", 0).when(F.col("lang") == "nl", 1)).alias("name"))
    path = steps.join(names, "step", "left").groupBy("notation").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", F.coalesce("name", "step").alias("n")))), lambda x: x["n"]), " > ").alias("cat"))
    rows = base.join(by("en"), "notation", "left").join(by("nl"), "notation", "left").join(kw, "notation", "left").join(path, "notation", "left")
    rows = rows.where("en is not null or nl is not null or size(kw) > 0")
    part = lambda tag, c: F.when(c.isNotNull() & (c != ""), F.concat(F.lit(f"[{tag}] "), c))
    return rows.select("notation", F.concat_ws(" ", part("Description", F.col("en")), part("Description NL", F.col("nl")), part("Keywords", F.array_join("kw", ", ")), part("Category", F.col("cat"))).alias("text"))
