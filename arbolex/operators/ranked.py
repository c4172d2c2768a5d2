"""Ranked retrieval from stored postings: buckets that meet without a shuffle, and blocks that a page can leave out.

Every text has a number, ``doc``. Postings are bucketed by it, so that those of all tokens of one text lie in one bucket and
tokens are intersected where they are read, from the rarest one outwards. Inside a bucket they are sorted by token and
block, so that a query reads its own tokens' pages only.

A block holds about ``BLOCK_TEXTS`` texts of like length: BM25 favours short texts, so blocks differ in how good their best
text can be. For each token and block the number of its texts and the largest impact are stored. A page of the best k
reads the blocks with the highest bounds first; its k-th score rules out all blocks whose bound is beneath it.

Ranks are those of ``text.search``: negated BM25 with the statistics of the whole index, whatever the scope. A phrase of
several tokens counts as one term; how many texts have it is known only when its tokens' postings have been intersected.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbolex.operators.text import B, K1, LEAST_IDF, Searcher
from arbolex.session import ship

BLOCK_TEXTS = 1024
CLASSES = 4  # of length, in each doubling
PIECE = 2 << 20  # bytes of texts whose postings are made at a time, or one text
FIRST_BLOCKS, MOST_BLOCKS = 16, 4096  # read at once; named one by one in a filter
_OWN = ("token", "doc", "block", "positions")


@dataclass
class Postings:
    """index: a row for each token and text. blocks: df and the largest impact (best) of each token and block; tokens: the
    same of each token; statistics: one row with the number of texts (_n) and their mean length (_avg)."""

    index: DataFrame
    blocks: DataFrame
    tokens: DataFrame
    statistics: DataFrame

    @property
    def rest(self) -> list[str]:
        return [c for c in self.index.columns if c not in _OWN]

    def frequencies(self, words: list[str]) -> dict[str, int]:
        """In how many texts each word of a query is."""
        return {r["token"]: r["df"] for r in self.tokens.where(F.col("token").isin(words)).select("token", "df").collect()}

    def searcher(self) -> Searcher:
        return lambda phrases, scope: search_postings(self, phrases, scope)


def impact(tf: Column | np.ndarray, n_tokens: Column | np.ndarray, avg: Column | float) -> Column | np.ndarray:
    """What a term adds to a text's score, but for its weight."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * n_tokens / avg))


def weight(n: float, df: float) -> float:
    return max(math.log((n - df + 0.5) / (df + 0.5)), LEAST_IDF)


def statistics(table_: DataFrame) -> DataFrame:
    """One row: the number of texts, those without tokens included, and their mean length in tokens."""
    return table_.agg(F.count(F.lit(1)).alias("_n"), F.avg("n_tokens").alias("_avg"))


def numbered(table_: DataFrame, block_texts: int = BLOCK_TEXTS) -> DataFrame:
    """The texts of a stored token table that have tokens, with doc and block."""
    rows = table_.where("n_tokens > 0").withColumn("doc", F.monotonically_increasing_id())
    kind = F.floor(F.log2("n_tokens") * CLASSES).cast("int")
    sizes = {r["kind"]: r["count"] for r in rows.groupBy(kind.alias("kind")).count().collect()}  # some hundred classes at most
    blocks, first, base = {}, {}, 0
    for k in sorted(sizes):
        blocks[k], first[k] = -(-sizes[k] // block_texts), base
        base += blocks[k]
    pick = lambda d: F.element_at(F.create_map(*(F.lit(x) for kv in (d or {0: 1}).items() for x in kv)), kind)
    return rows.withColumn("block", (pick(first) + F.pmod(F.xxhash64("doc"), pick(blocks))).cast("long"))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches whose last column is ``padded`` in pieces of about PIECE bytes of it."""
    for batch in batches:
        size = np.cumsum(np.asarray(pc.binary_length(batch.column(batch.num_columns - 1)), np.int64))
        lo = 0
        while lo < batch.num_rows:
            most = (size[lo - 1] if lo else 0) + PIECE
            hi = max(lo + 1, int(np.searchsorted(size, most, "right")))
            yield batch.slice(lo, hi - lo)
            lo = hi


def _tokens(padded: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """For each text and token of it: the token, the text's place, and where its positions begin and, last, end; and these."""
    words = pc.split_pattern(pc.utf8_trim(padded, characters=" "), " ")
    offsets = np.asarray(words.offsets, np.int64)
    count = np.diff(offsets)
    of, at = np.repeat(np.arange(len(count)), count), np.arange(offsets[-1] - offsets[0]) - np.repeat(offsets[:-1] - offsets[0], count)
    coded = words.flatten().dictionary_encode()
    code, names = np.asarray(coded.indices, np.int64), coded.dictionary
    some = np.asarray(pc.binary_length(names), np.int64)[code] > 0
    of, at, code = of[some], at[some], code[some]
    key = of * (len(names) + 1) + code
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])[: len(key)])
    lead = order[first]
    return names.take(pa.array(code[lead])), of[lead], np.append(first, len(key)).astype(np.int32), at[order].astype(np.int32)


def index(texts: DataFrame) -> DataFrame:
    """The postings of numbered texts: token, doc, block, their other columns but ``padded``, and positions. Each text's are made
    where it is: texts may be moved to where postings are wanted, which are several times as large."""
    ship(texts.sparkSession)
    own = ["doc", "block", *(c for c in texts.columns if c not in ("padded", "doc", "block"))]
    schema = ", ".join(f"`{c}` {texts.schema[c].dataType.simpleString()}" for c in own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _pieces(batches):
            token, of, edges, at = _tokens(part.column(len(own)))
            text = pa.array(of)
            yield pa.record_batch([token, *(part.column(i).take(text) for i in range(len(own))), pa.ListArray.from_arrays(pa.array(edges), pa.array(at))], names=["token", *own, "positions"])

    return texts.select(*own, "padded").mapInArrow(run, f"token string, {schema}, positions array<int>")


def block_table(texts: DataFrame, statistics_: DataFrame, parts: int) -> DataFrame:
    """token, block, df and best of numbered texts. The texts of a block, some thousand, are brought to one task, which
    sums them up in full; no postings are moved."""
    ship(texts.sparkSession)
    avg = statistics_.first()["_avg"]

    def merged(held: list[pa.Table]) -> pa.Table:
        got = pa.concat_tables(held).group_by(["block", "token"]).aggregate([("df", "sum"), ("best", "max")])
        return got.select(["block", "token", "df_sum", "best_max"]).rename_columns(["block", "token", "df", "best"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for part in _pieces(batches):  # sorted by block; the last one of a piece may go on in the next
            token, of, edges, _ = _tokens(part.column(2))
            if not len(of):
                continue
            tf, n = np.diff(edges).astype(np.float64), np.asarray(part.column(1), np.float64)[of]
            new = pa.table({"block": part.column(0).take(pa.array(of)), "token": token, "df": pa.array(np.ones(len(of), np.int64)), "best": pa.array(impact(tf, n, avg))})
            held.append(merged([new]))
            last = part.column(0)[-1].as_py()
            if held[0]["block"][0].as_py() != last or len(held) > 64:
                whole = merged(held)
                done = pc.not_equal(whole["block"], last)
                yield from whole.filter(done).select(["token", "block", "df", "best"]).combine_chunks().to_batches()
                held = [whole.filter(pc.invert(done))]
                held = held if held[0].num_rows else []
        if held:
            yield from merged(held).select(["token", "block", "df", "best"]).combine_chunks().to_batches()

    rows = texts.select("block", "n_tokens", "padded").repartition(parts, "block").sortWithinPartitions("block")
    return rows.mapInArrow(run, "token string, block long, df long, best double")


def token_totals(blocks: DataFrame) -> DataFrame:
    """token, df, best and in how many blocks it is."""
    return blocks.groupBy("token").agg(F.sum("df").alias("df"), F.max("best").alias("best"), F.count(F.lit(1)).alias("blocks"))


def _moved(positions: Column, by: int) -> Column:
    return F.transform(positions, lambda x: x - by) if by else positions


def _places(p: Postings, phrase: list[str], df: dict[str, int], where: Column | None) -> DataFrame:
    """doc, the index's other columns, and _tf, how often the phrase occurs: texts that have the rarest token, and of these
    those that have the next one, and so on. Buckets meet where they are; the few build the hash table."""
    words = sorted(set(phrase), key=lambda w: (df[w], w))
    got = None
    for i, w in enumerate(words):
        rows = p.index.where(F.col("token") == w)
        rows = rows if where is None else rows.where(where)
        own = rows.select("doc", F.col("positions").alias(f"_w{i}"), *([] if got is not None else p.rest))
        got = own if got is None else own.join(got.hint("shuffle_hash"), "doc")
    met = None
    for k, w in enumerate(phrase):
        at = _moved(F.col(f"_w{words.index(w)}"), k)
        met = at if met is None else F.array_intersect(met, at)
    return got.select("doc", *p.rest, F.size(met).alias("_tf")).where("_tf > 0")


def _all_places(p: Postings, phrases: list[list[str]], df: dict[str, int], where: Column | None) -> DataFrame:
    """doc, the other columns, and _tf0, _tf1, ...: the texts that have every phrase."""
    order = sorted(range(len(phrases)), key=lambda i: min(df[w] for w in phrases[i]))
    got = None
    for i in order:
        own = _places(p, phrases[i], df, where).withColumnRenamed("_tf", f"_tf{i}")
        got = own if got is None else own.drop(*p.rest).join(got.hint("shuffle_hash"), "doc")
    return got


def _nothing(p: Postings) -> DataFrame:
    return p.index.where(F.lit(False)).select(*(c for c in p.rest if c != "n_tokens"), F.lit(0.0).alias("rank"))


def search_postings(p: Postings, phrases: list[list[str]], scope: Column | None = None) -> DataFrame:
    """What ``text.search`` gives, from postings: all texts that have every phrase, with their rank."""
    df = p.frequencies(sorted({w for x in phrases for w in x})) if phrases else {}
    if not phrases or any(w not in df for x in phrases for w in x):
        return _nothing(p)
    weights = p.statistics  # one row, and so is each count
    for i, x in enumerate(phrases):
        if len(x) == 1:
            weights = weights.withColumn(f"_df{i}", F.lit(df[x[0]]))
        else:
            weights = weights.crossJoin(_places(p, x, df, None).agg(F.count(F.lit(1)).alias(f"_df{i}")))
    hits = _all_places(p, phrases, df, scope).crossJoin(F.broadcast(weights))
    score = F.lit(0.0)
    for i in range(len(phrases)):
        idf = F.greatest(F.log((F.col("_n") - F.col(f"_df{i}") + 0.5) / (F.col(f"_df{i}") + 0.5)), F.lit(LEAST_IDF))
        score = score + idf * impact(F.col(f"_tf{i}").cast("double"), F.col("n_tokens"), F.col("_avg"))
    return hits.select(*(c for c in p.rest if c != "n_tokens"), (-score).alias("rank"))


@dataclass
class Page:
    """The best k rows, and how many postings of the query's tokens were read for them, of how many."""

    rows: DataFrame
    read: int
    there: int


def page(p: Postings, phrases: list[list[str]], k: int, scope: Column | None = None, first_blocks: int = FIRST_BLOCKS) -> Page:
    """The k texts of the best rank; ties go by the index's columns in their order. Exact: a block is left out only if the
    sum of its terms' largest impacts is beneath the k-th score found in the blocks of the highest bounds."""
    words = sorted({w for x in phrases for w in x})
    df = p.frequencies(words) if phrases else {}
    if not phrases or len(df) < len(words):
        return Page(_nothing(p), 0, 0)
    n, avg = p.statistics.first()
    weights = [weight(n, df[x[0]] if len(x) == 1 else _places(p, x, df, None).count()) for x in phrases]
    asked = p.blocks.where(F.col("token").isin(words))
    best = asked.groupBy("block").agg(F.sum("df").alias("n"), *(F.max(F.when(F.col("token") == w, F.col("best"))).alias(f"b{i}") for i, w in enumerate(words)))
    for i in range(len(words)):
        best = best.where(f"b{i} is not null")
    bound = F.lit(0.0)
    for x, idf in zip(phrases, weights):  # a phrase occurs no more often than any of its tokens
        own = [F.col(f"b{words.index(w)}") for w in set(x)]
        bound = bound + idf * (F.least(*own) if len(own) > 1 else own[0])
    best = best.select("block", "n", (bound * (1 + 1e-9)).alias("bound"))

    def scored(where: Column | None) -> DataFrame:
        hits = _all_places(p, phrases, df, where if scope is None else scope if where is None else where & scope)
        score = F.lit(0.0)
        for i, idf in enumerate(weights):
            score = score + idf * impact(F.col(f"_tf{i}").cast("double"), F.col("n_tokens"), F.lit(avg))
        keep = [c for c in p.rest if c != "n_tokens"]
        return hits.select(*keep, (-score).alias("rank")).orderBy("rank", *keep).limit(k)

    highest = F.desc("bound"), F.col("block")
    first = best.orderBy(*highest).limit(first_blocks).collect()
    there = sum(df[w] for w in words)
    if not first:
        return Page(_nothing(p), 0, there)
    named = [r["block"] for r in first]
    found = scored(F.col("block").isin(named)).select("rank").collect()  # k rows
    least = -found[-1]["rank"] if len(found) == k else -math.inf
    more = best.where((F.col("bound") >= F.lit(least)) & ~F.col("block").isin(named)).orderBy(*highest).limit(MOST_BLOCKS + 1).collect()
    if len(more) > MOST_BLOCKS:  # too many to name: nearly all of the index may hold a better text
        return Page(scored(None), there, there)
    named += [r["block"] for r in more]
    return Page(scored(F.col("block").isin(named)), sum(r["n"] for r in [*first, *more]), there)
