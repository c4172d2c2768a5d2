"""Full-text search over labels: phrases, AND of terms, BM25 with corpus-wide statistics.

There are two forms of index. A token table has one row per text: ``padded`` holds the tokens between spaces and ``n_tokens`` their
number. It is scanned whole. Postings (``ranked``) have one row per token and text, with the token's positions. Both give the same hits
and ranks. Tokenising is the costly step, so either is written at ingest and queries start from it; filters on derived
columns would otherwise make the optimizer tokenise again for each of them.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbolex.functions.scalars import spaced

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
_DROPPED = r'[.*^():{}\[\]\\]'


def phrase_of(query: str) -> str | None:
    """A query as one phrase: marks are deleted, quotes doubled; None if nothing is left."""
    text = re.sub(_DROPPED, "", query).replace('"', '""').strip()
    return f'"{text}"' if text else None


def terms_of(query: str) -> str | None:
    """A query as an AND of words: marks, quotes and slashes part words; None for fewer than two."""
    words = re.sub(r'[.*^():{}\[\]\\"/]', " ", query).split()
    return " AND ".join(f'"{w}"' for w in words) if len(words) > 1 else None


def _plain_tokens(text: str) -> list[str]:
    """Tokens of a query, on the driver, as ``tokens`` makes them of a column."""
    import unicodedata

    from arbolex.functions.scalars import _ACCENTED, _PLAIN

    low = text.lower().translate(str.maketrans(_ACCENTED, _PLAIN))
    low = "".join(c for c in low if unicodedata.category(c) != "Mn")
    return re.findall(r"[^\W_]+", low)


def phrase_tokens(query: str) -> list[list[str]]:
    """Token lists of the phrase form: one operand, or none."""
    expr = phrase_of(query)
    got = _plain_tokens(expr) if expr else []
    return [got] if got else []


def term_tokens(query: str) -> list[list[str]]:
    """Token lists of the AND form; a word without tokens makes the whole query match nothing, so it gives none."""
    expr = terms_of(query)
    if not expr:
        return []
    got = [_plain_tokens(w) for w in expr.split(" AND ")]
    return got if all(got) else []


def token_table(df: DataFrame, text: str | Column, *keep: str) -> DataFrame:
    """The index of ``text``: the kept columns, padded and n_tokens."""
    text = F.col(text) if isinstance(text, str) else text
    rows = df.select(*keep, spaced(F.coalesce(text, F.lit(""))).alias("padded"))
    return rows.withColumn("n_tokens", F.length("padded") - F.length(F.replace(F.col("padded"), F.lit(" "), F.lit(""))) - 1)


def occurrences(phrase: list[str]) -> Column:
    """How often consecutive tokens occur, overlaps included. Tokens hold letters and digits only. A plain search comes
    first, since most texts have none."""
    words = f" {' '.join(phrase)} "
    return F.when(F.contains(F.col("padded"), F.lit(words)), F.regexp_count(F.col("padded"), F.lit(f"(?={words})"))).otherwise(0)


def search(index: DataFrame, phrases: list[list[str]], scope: Column | None = None) -> DataFrame:
    """Rows of the index in which every phrase occurs, with their rank, the negated BM25 score: smaller is better.

    Each phrase counts as one term. Statistics are those of the whole index; ``scope`` only filters what is returned."""
    if not phrases:
        return index.where(F.lit(False)).withColumn("rank", F.lit(0.0)).drop("padded")
    counts = index.withColumns({f"_tf{i}": occurrences(p) for i, p in enumerate(phrases)}).drop("padded")
    stats = counts.agg(
        F.count(F.lit(1)).alias("_n"),
        F.avg("n_tokens").alias("_avg"),
        *(F.count_if(F.col(f"_tf{i}") > 0).alias(f"_df{i}") for i in range(len(phrases))),
    )
    return _scored(counts, stats, len(phrases), scope)


def _scored(counts: DataFrame, statistics: DataFrame, n: int, scope: Column | None) -> DataFrame:
    """Rows with all terms, and their rank, from term counts _tf and one row of _n, _avg and _df."""
    hits = counts
    for i in range(n):
        hits = hits.where(F.col(f"_tf{i}") > 0)
    if scope is not None:
        hits = hits.where(scope)
    hits = hits.crossJoin(F.broadcast(statistics))  # one row
    score = F.lit(0.0)
    for i in range(n):
        idf = F.greatest(F.log((F.col("_n") - F.col(f"_df{i}") + 0.5) / (F.col(f"_df{i}") + 0.5)), F.lit(LEAST_IDF))
        tf = F.col(f"_tf{i}").cast("double")
        score = score + idf * (tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("n_tokens") / F.col("_avg"))))
    return hits.withColumn("rank", -score).drop("n_tokens", *(c for c in hits.columns if c.startswith("_")))


def best_ranks(hits: list[DataFrame], key: str) -> DataFrame:
    """The smallest rank of each key over several indexes, whose scores are compared as they are."""
    both = hits[0].select(key, "rank")
    for h in hits[1:]:
        both = both.unionByName(h.select(key, "rank"))
    return both.groupBy(key).agg(F.min("rank").alias("rank"))


Searcher = Callable[[list[list[str]], Column | None], DataFrame]


def scanning(index: DataFrame) -> Searcher:
    """Search over a token table."""
    return lambda phrases, scope: search(index, phrases, scope)


def all_hits(indexes: list[DataFrame | Searcher], phrases: list[list[str]], key: str, scope: Column | None = None) -> DataFrame:
    """The best rank of each key that has every phrase, over all indexes."""
    return best_ranks([(i if callable(i) else scanning(i))(phrases, scope) for i in indexes], key)


def search_with_fallback(indexes: list[DataFrame | Searcher], query: str, key: str, scope: Column | None = None) -> DataFrame:
    """The phrase's hits over all indexes; only if there are none at all, those of the AND of its words. One plan, which
    holds both forms; a caller that may run a job in between looks the second up only after the first (``Engine.matches``)."""
    phrases, terms = phrase_tokens(query), term_tokens(query)
    exact = all_hits(indexes, phrases, key, scope)
    if not terms:
        return exact
    loose = all_hits(indexes, terms, key, scope)
    some = exact.agg(F.count(F.lit(1)).alias("_some"))  # one row
    return exact.unionByName(loose.crossJoin(F.broadcast(some)).where("_some = 0").select(key, "rank"))


def unique_hits(indexes: dict[str, DataFrame], queries: list[str], key: str) -> DataFrame:
    """query, one column for each index with how many distinct keys its phrase hits there, and ``combined``, how many in any.
    One pass over each index for all queries."""
    asked = [(q, phrase_tokens(q)) for q in queries]
    parts = []
    for name, index in indexes.items():
        hit = F.array_compact(F.array(*(F.when(occurrences(p[0]) > 0 if p else F.lit(False), F.lit(q)) for q, p in asked)))
        parts.append(index.select(key, F.explode(hit).alias("query")).select("query", key, F.lit(name).alias("_index")))
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    sums = both.groupBy("query").agg(*(F.count_distinct(F.when(F.col("_index") == n, F.col(key))).alias(n) for n in indexes), F.count_distinct(key).alias("combined"))
    names = both.sparkSession.createDataFrame([(q,) for q in dict.fromkeys(queries)], "query string")
    return names.join(sums, "query", "left").select("query", *(F.coalesce(n, F.lit(0)).alias(n) for n in (*indexes, "combined")))
