"""Overlays: which collections use a code, and how often."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbolex.functions.scalars import nested_url, templated_url


def coverage(keys: DataFrame, counts: DataFrame, collection: str | None = None, key: str = "notation") -> DataFrame:
    """Adds coverage: in how many collections a key is; 1 or 0 for one collection."""
    held = counts.where(F.col("collection_id") == collection) if collection else counts
    held = held.groupBy(key).agg(F.count_distinct("collection_id").alias("coverage"))
    return keys.join(held, key, "left").withColumn("coverage", F.coalesce("coverage", F.lit(0)))


def present(keys: DataFrame, counts: DataFrame, collection: str | None = None, key: str = "notation") -> DataFrame:
    """The keys that one collection, or any, holds: a semi-join, with no duplicates to remove."""
    held = counts.where(F.col("collection_id") == collection) if collection else counts
    return keys.join(held.select(key), key, "left_semi")


SUMS = "kind string, name string, coverage int, collections array<string>, known long"


def sums(counts: DataFrame, notations: DataFrame) -> DataFrame:
    """What searches need of the overlay, kept beside it. Rows of kind 'code': a code's collections in order, and how many
    they are; of kind 'collection': how many codes of the vocabulary it holds (known)."""
    pairs = counts.select("collection_id", "notation").distinct()
    none = F.lit(None)
    codes = pairs.groupBy("notation").agg(F.array_sort(F.collect_set("collection_id")).alias("collections"))  # as long as there are collections
    known = pairs.join(notations.select("notation"), "notation", "left_semi").groupBy("collection_id").agg(F.count(F.lit(1)).alias("known"))
    rows = codes.select(F.lit("code").alias("kind"), F.col("notation").alias("name"), F.size("collections").alias("coverage"), "collections", none.cast("long").alias("known"))
    return rows.unionByName(known.select(F.lit("collection").alias("kind"), F.col("collection_id").alias("name"), none.cast("int").alias("coverage"), none.cast("array<string>").alias("collections"), "known"))


def changed_sums(old: DataFrame, new: DataFrame, notations: DataFrame) -> DataFrame:
    """The rows of ``sums`` that upserting ``new`` (collection_id, notation) changes, from the old ones of its codes and
    collections alone. What is there already changes nothing, so a run that was cut off can be repeated."""
    new = new.select("collection_id", "notation").distinct()
    codes = old.where("kind = 'code'").select(F.col("name").alias("notation"), F.col("collections").alias("_old"))
    more = new.groupBy("notation").agg(F.collect_set("collection_id").alias("_new"))
    both = codes.join(more, "notation", "right").select("notation", F.coalesce("_old", F.array().cast("array<string>")).alias("_old"), "_new")
    both = both.withColumn("_added", F.array_except("_new", "_old")).where(F.size("_added") > 0)
    all_ = F.array_sort(F.concat("_old", "_added"))
    rows = both.select(F.lit("code").alias("kind"), F.col("notation").alias("name"), F.size(all_).alias("coverage"), all_.alias("collections"), F.lit(None).cast("long").alias("known"))
    grown = both.join(notations.select("notation"), "notation", "left_semi").select(F.explode("_added").alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("_n"))
    before = old.where("kind = 'collection'").select("name", F.col("known").alias("_was"))
    totals = before.join(grown, "name", "right").select(F.lit("collection").alias("kind"), "name", F.lit(None).cast("int").alias("coverage"), F.lit(None).cast("array<string>").alias("collections"), (F.coalesce("_was", F.lit(0)) + F.col("_n")).alias("known"))
    return rows.unionByName(totals)


def kept_coverage(keys: DataFrame, sums_: DataFrame, collection: str | None = None, key: str = "notation") -> DataFrame:
    """``coverage`` from the sums that are kept: no aggregate of the overlay."""
    n = F.when(F.array_contains("collections", F.lit(collection)), 1).otherwise(0) if collection else F.col("coverage")
    held = sums_.where("kind = 'code'").select(F.col("name").alias(key), n.cast("long").alias("coverage"))
    return keys.join(held, key, "left").withColumn("coverage", F.coalesce("coverage", F.lit(0)))


def kept_totals(info: DataFrame, sums_: DataFrame) -> DataFrame:
    """``collection_totals`` from the sums that are kept."""
    totals = sums_.where("kind = 'collection'").select(F.col("name").alias("collection_id"), F.col("known").alias("known_notations"))
    return info.join(totals, "collection_id", "left").withColumn("known_notations", F.coalesce("known_notations", F.lit(0)))


def collection_totals(info: DataFrame, counts: DataFrame, notations: DataFrame) -> DataFrame:
    """Collections with the number of their codes that the vocabulary knows; 0 without rows."""
    known = counts.select("collection_id", "notation").distinct().join(notations.select("notation"), "notation", "left_semi")
    totals = known.groupBy("collection_id").agg(F.count(F.lit(1)).alias("known_notations"))
    return info.join(totals, "collection_id", "left").withColumn("known_notations", F.coalesce("known_notations", F.lit(0)))


def holdings(codes: DataFrame, labels: DataFrame, counts: DataFrame, info: DataFrame, aggregator: str) -> DataFrame:
    """For each row of ``codes`` (pos, notation), known or not: its label or itself, and the collections that hold it with
    counts, largest first, and links."""
    asked = codes.select("notation").distinct()
    held = counts.join(F.broadcast(asked), "notation").join(info, "collection_id", "left")
    item = F.struct(
        (-F.col("count")).alias("o"),
        "collection_id",
        F.coalesce("label", "collection_id").alias("label"),
        "count",
        templated_url(F.col("search_url_template"), F.col("notation")).alias("url"),
    )
    held = held.groupBy("notation").agg(F.array_sort(F.collect_list(item)).alias("_held"))
    held = held.select("notation", F.transform("_held", lambda x: F.struct(x["collection_id"].alias("collection_id"), x["label"].alias("label"), x["count"].alias("count"), x["url"].alias("url"))).alias("collections"))
    out = codes.join(labels, "notation", "left").join(held, "notation", "left")
    kind = held.schema["collections"].dataType
    return out.select("pos", "notation", F.coalesce("text", "notation").alias("text"), F.coalesce("collections", F.array().cast(kind)).alias("collections"), nested_url(F.col("notation"), aggregator).alias("aggregator_url")).orderBy("pos")


def counts_per_code(mappings: DataFrame, vocabulary: DataFrame, fields: DataFrame | None = None) -> DataFrame:
    """notation and count: distinct works per classification code, most first. Takes either layout of the source:
    (artwork_id, vocab_rowid, field_id) or (object_number, vocab_id, field)."""
    vocabulary = vocabulary.where("type = 'classification' and notation is not null and notation != ''")
    if "artwork_id" in mappings.columns:
        joined = mappings.join(vocabulary, mappings["vocab_rowid"] == vocabulary["vocab_int_id"])
        if fields is not None:
            joined = joined.join(F.broadcast(fields.select(F.col("id").alias("field_id"), F.col("name").alias("field"))), "field_id").where("field = 'subject'")
        work = "artwork_id"
    else:
        joined, work = mappings.where("field = 'subject'").join(vocabulary, mappings["vocab_id"] == vocabulary["id"]), "object_number"
    return joined.groupBy("notation").agg(F.count_distinct(work).alias("count")).orderBy(F.desc("count"), "notation")


def held_share(hits: DataFrame, counts: DataFrame, key: str = "notation", places: int = 6) -> DataFrame:
    """collection_id and share: what part of the hits each collection holds."""
    n = hits.agg(F.count(F.lit(1)).alias("_n"))  # one row
    held = counts.join(hits.select(key), key, "left_semi").groupBy("collection_id").agg(F.count_distinct(key).alias("_held"))
    rows = counts.select("collection_id").distinct().join(held, "collection_id", "left").crossJoin(F.broadcast(n))
    return rows.select("collection_id", F.round(F.coalesce("_held", F.lit(0)) / F.greatest("_n", F.lit(1)), places).alias("share"))
