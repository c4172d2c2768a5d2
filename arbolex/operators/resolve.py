"""Labels and keywords with language fallback, and whole entries for a page of codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYWORD_CAP = 40


def fallbacks(lang: str) -> list[str]:
    """The asked language, then en, then nl, each once."""
    return list(dict.fromkeys([lang, "en", "nl"]))


def language_rank(lang: Column, chain: list[str]) -> Column:
    """Place in the chain; languages outside it come last."""
    at = F.array_position(F.array(*(F.lit(x) for x in chain)), lang)
    return F.when(at > 0, at).otherwise(F.lit(len(chain) + 1))


def labels(texts: DataFrame, lang: str, key: str = "notation") -> DataFrame:
    """key and text: the first label in the chain, else that of the first language by name; first stored first. One
    aggregation, with a partial step before the shuffle."""
    order = F.struct(language_rank(F.col("lang"), fallbacks(lang)).alias("r"), F.col("lang"), F.col("ord"))
    return texts.groupBy(key).agg(F.min_by("text", order).alias("text"))


def keywords(words: DataFrame, lang: str, key: str = "notation", cap: int = KEYWORD_CAP) -> DataFrame:
    """key and keywords: those of the first language in the chain that has any, at most ``cap``, as stored; without
    one, the first ``cap`` of all languages."""
    chain = fallbacks(lang)
    ranked = words.withColumn("_r", language_rank(F.col("lang"), chain))
    best = ranked.groupBy(key).agg(F.min("_r").alias("_best"))
    rows = ranked.join(best, key).where("_r = _best")
    place = F.row_number().over(Window.partitionBy(key).orderBy("lang", "ord", "keyword"))
    first = rows.withColumn("_place", place).where(F.col("_place") <= cap)  # cut in each task before the shuffle, too
    return first.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_place", "keyword"))), lambda x: x["keyword"]).alias("keywords"))


def entries(vocabulary, page: DataFrame, lang: str = "en") -> DataFrame:
    """Whole entries for the codes of ``page`` (pos, notation): one row for each known code, in page order.

    A page has at most a few hundred codes, so it is broadcast and every table is cut down to it first."""
    page = F.broadcast(page)
    rows = in_order(page, vocabulary.notations)
    wanted = rows.select("notation").unionByName(rows.select(F.explode("path").alias("notation"))).distinct()
    label = labels(vocabulary.texts.join(wanted, "notation", "left_semi"), lang)
    words = keywords(vocabulary.keywords.join(page.select("notation").distinct(), "notation", "left_semi"), lang)
    steps = rows.select("pos", F.posexplode("path").alias("_at", "step")).join(label.withColumnRenamed("notation", "step"), "step", "left")
    steps = steps.groupBy("pos").agg(F.array_sort(F.collect_list(F.struct("_at", F.col("step").alias("notation"), F.coalesce("text", "step").alias("text")))).alias("_path"))
    held = vocabulary.sums.where("kind = 'code'").select(F.col("name").alias("notation"), "collections").join(page.select("notation").distinct(), "notation", "left_semi")
    none = F.array().cast("array<string>")
    out = rows.join(label, "notation", "left").join(words, "notation", "left").join(steps, "pos", "left").join(held, "notation", "left")
    return out.select(
        "pos",
        "notation",
        F.coalesce("text", "notation").alias("text"),
        F.coalesce(F.transform("_path", lambda x: F.struct(x["notation"].alias("notation"), x["text"].alias("text"))), F.array().cast("array<struct<notation:string,text:string>>")).alias("path"),
        "children",
        "refs",
        F.coalesce("keywords", none).alias("keywords"),
        "is_key_expanded",
        "base_notation",
        "key_id",
        F.coalesce("collections", none).alias("collections"),
    ).orderBy("pos")


def in_order(page: DataFrame, known: DataFrame, key: str = "notation") -> DataFrame:
    """What is known of each code of a page (pos, key), in the page's order with its repeats; unknown codes are dropped."""
    return F.broadcast(page).join(known, key).select("pos", *known.columns).orderBy("pos")


def cross_references(refs: DataFrame, known: DataFrame, key: str = "ref") -> DataFrame:
    """The references of a page of codes (key, and what orders them) with what is known of them: the known ones first, then
    the rest as bare codes. ``known`` has a column of the key's name; it is cut down to the page first."""
    return refs.join(known.join(F.broadcast(refs.select(key).distinct()), key, "left_semi").withColumn("_known", F.lit(0)), key, "left").withColumn("_known", F.coalesce("_known", F.lit(1)))
