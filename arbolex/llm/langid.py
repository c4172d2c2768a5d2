"""Language identification by prediction by partial matching.

Training counts, per language, which byte follows each context of 0 to 3 bytes (case-folded text). A language's code
length of a text is the sum over its bytes of -log2 of the probability in the longest context that has been seen, after
the escapes from longer ones (method C: an escape weighs as much as the number of distinct successors). The statistics
are frozen before scoring. The language with the shortest code wins; the score is its share of exp(-code length).

Training is spread: each task counts its own documents, and the counts are added up by context. Only documents with a
non-null lang whose crc32(doc_id as text) mod 4 is not 2 are used, and of these a sample of about TRAIN_BYTES of text a
language, drawn by a hash of doc_id; the document with the smallest hash of each language is always drawn. The model has
a row for each byte sequence of the sample and a column for each language, so with many languages each gets a smaller
sample: about MODEL_CELLS / languages**2 bytes. That bounds what the driver collects and what is broadcast by 4 * MODEL_CELLS bytes, or
by one document a language if that is more. No language is left out.

Defined cases: a null text or one without a letter is ``und`` with score 0; learnable rows without text teach nothing,
and a language with no others is not learned; without training rows all is ``und``; ties
go to the alphabetically first language; repeated rows are scored alike; an empty table gives no rows; other columns,
whatever their names, are ignored. lang, source and doc_id take no part in a prediction.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Chunk, chunks, documents

ORDER = 3  # bytes of context
TRAIN_BYTES = 1_500_000  # text a language in the training sample, about
MODEL_CELLS = 256_000_000  # byte sequences times languages in the model, about; reached from 14 languages on
FOLD = np.arange(256, dtype=np.uint32)
FOLD[65:91] += 32
UNDETERMINED = "und"
_HASH_BITS = 22


def held_out(doc_id: F.Column) -> F.Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def _keys(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each byte, the byte and the three before it as one number; before a document's start stand spaces."""
    folded = FOLD[data]
    upper = (folded >= 0x80) & (folded <= 0x9E) & (folded != 0x97)  # capitals of the Latin-1 letters follow 0xC3
    upper[1:] &= data[:-1] == 0xC3
    upper[:1] = False
    folded[upper] += 32
    key = folded.copy()
    for back in (1, 2, 3):
        prior = np.full(len(data), 32, np.uint32)
        prior[back:] = folded[:-back] if len(data) > back else prior[back:]
        starts = offsets[:-1]
        for j in range(back):
            at = starts[starts + j < offsets[1:]] + j
            prior[at] = 32
        key |= prior << np.uint32(8 * back)
    return key


@dataclass
class Model:
    """Frozen statistics, resolved to code lengths.

    ``full`` are the sorted 4-byte sequences seen in any language and ``bits`` their code lengths by language. For a
    sequence not among them, ``escape[k]`` has the escape from its context of k bytes and ``lower[k]`` the code lengths
    after shorter contexts, each with zeros for contexts that are unknown.
    """

    languages: list[str]
    levels: list[tuple[np.ndarray, np.ndarray]]  # order 0..3: sorted keys, (n, L) code lengths
    escapes: list[tuple[np.ndarray, np.ndarray]]  # context of 1..3 bytes: sorted contexts, (n, L) escape costs
    floor: np.ndarray  # code length of a byte never seen

    def index(self) -> np.ndarray:
        """A direct table from hashed 4-byte sequences to their row, or -1; rows that collide are left to a search."""
        keys = self.levels[ORDER][0]
        slots = np.full(1 << _HASH_BITS, -1, np.int32)
        slots[_slot(keys)] = np.arange(len(keys), dtype=np.int32)
        return slots

    def cost(self, keys: np.ndarray, order: int) -> np.ndarray:
        """Code lengths by language where the context has at most ``order`` bytes; exact for any key."""
        if order < 0:
            return np.broadcast_to(self.floor, (len(keys), len(self.languages)))
        known, bits = self.levels[order]
        part = keys & np.uint32((1 << (8 * (order + 1))) - 1) if order < 3 else keys
        at = np.minimum(np.searchsorted(known, part), max(0, len(known) - 1))
        hit = known[at] == part if len(known) else np.zeros(len(keys), bool)
        out = np.zeros((len(keys), len(self.languages)), np.float32)
        if hit.any():
            out[hit] = bits[at[hit]]
        miss = np.flatnonzero(~hit)
        if len(miss):
            low = self.cost(keys[miss], order - 1).copy()
            contexts, costs = self.escapes[order]
            ctx = part[miss] >> np.uint32(8)
            c = np.minimum(np.searchsorted(contexts, ctx), max(0, len(contexts) - 1))
            seen = contexts[c] == ctx if len(contexts) else np.zeros(len(miss), bool)
            low[seen] += costs[c[seen]]
            out[miss] = low
        return out


def _slot(keys: np.ndarray) -> np.ndarray:
    return (keys * np.uint32(2654435761)) >> np.uint32(32 - _HASH_BITS)


def resolve(languages: list[str], lang: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> Model:
    """Turns counts of (language number, 4-byte sequence) into code lengths with escapes, exactly as one would walk the
    context trees."""
    n_lang = len(languages)
    floor = np.full(n_lang, 8.0, np.float32)  # below order 0 all 256 bytes are as likely
    model = Model(languages, [], [], floor)
    for order in range(ORDER + 1):
        mask = np.uint32((1 << (8 * (order + 1))) - 1) if order < 3 else np.uint32(0xFFFFFFFF)
        part = keys & mask
        known, at = np.unique(part, return_inverse=True)
        count = np.zeros((len(known), n_lang))
        np.add.at(count, (at, lang), counts)
        contexts, ctx = np.unique(known >> np.uint32(8), return_inverse=True)
        total, kinds = np.zeros((len(contexts), n_lang)), np.zeros((len(contexts), n_lang))
        np.add.at(total, ctx, count)
        np.add.at(kinds, ctx, count > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            escape = np.where(total > 0, -np.log2(kinds / (total + kinds)), 0.0).astype(np.float32)
            own = -np.log2(count / (total + kinds)[ctx])
        model.escapes.append((contexts.astype(np.uint32), escape))
        low = model.cost(known.astype(np.uint32), order - 1)
        bits = np.where(count > 0, own, escape[ctx] + low).astype(np.float32)
        model.levels.append((known.astype(np.uint32), bits))
    return model


def train(docs: DataFrame, budget: int = TRAIN_BYTES, cells: int = MODEL_CELLS) -> Model:
    """Counts the training sample and freezes it. The driver gets one row for each language and byte sequence."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang"))
    rows = rows.where((F.octet_length("text") > 0) & F.col("lang").isNotNull() & ~F.coalesce(held_out(F.col("doc_id")), F.lit(False)))
    draw = F.pmod(F.xxhash64("doc_id", F.lit(8)), F.lit(1 << 30)) / float(1 << 30)
    size = {r["lang"]: (r["n"], r["least"]) for r in rows.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("n"), F.min(draw).alias("least")).collect()}
    languages = sorted(size)
    if not languages:
        return Model([], [], [], np.zeros(0, np.float32))
    budget = min(budget, max(1, cells // len(languages) ** 2))
    share = F.create_map(*(x for k in languages for x in (F.lit(k), F.lit(max(budget / size[k][0], size[k][1])))))
    number = F.create_map(*(x for i, k in enumerate(languages) for x in (F.lit(k), F.lit(i))))
    sample = rows.where(draw <= share[F.col("lang")]).select(number[F.col("lang")].alias("l"), "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.asarray(batch.column("l"))
            for chunk in chunks(batch.column("text")):
                key = _keys(chunk.data, chunk.offsets).astype(np.int64)
                key |= np.repeat(langs[chunk.rows.start : chunk.rows.stop].astype(np.int64), np.diff(chunk.offsets)) << 32
                k, n = np.unique(key, return_counts=True)
                yield pa.record_batch({"k": pa.array(k), "n": pa.array(n.astype(np.int64))})

    got = sample.mapInArrow(count, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    k, n = np.asarray(got["k"]), np.asarray(got["n"])
    return resolve(languages, k >> 32, (k & 0xFFFFFFFF).astype(np.uint32), n)


def code_lengths(model: Model, slots: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(documents, languages): exact code lengths in bits."""
    keys = _keys(data, offsets)
    known, bits = model.levels[ORDER]
    at = slots[_slot(keys)]
    sure = (at >= 0) & (known[at] == keys)
    rest = np.flatnonzero(~sure)
    at[rest] = 0
    out = np.empty((len(offsets) - 1, len(model.languages)))
    extra = model.cost(keys[rest], ORDER) if len(rest) else None
    for lang in range(len(model.languages)):
        cost = bits[:, lang][at]
        if extra is not None:
            cost[rest] = extra[:, lang]
        total = np.zeros(len(cost) + 1)
        np.cumsum(cost, out=total[1:], dtype=np.float64)
        out[:, lang] = total[offsets[1:]] - total[offsets[:-1]]
    return out


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, lang_pred, score, bits_per_byte for every document."""
    model = model or train(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    if not model.languages:
        return rows.select("doc_id", F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("bits_per_byte"))
    held = docs.sparkSession.sparkContext.broadcast(model)  # bounded by MODEL_CELLS

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, slots = _ready(held.value)
        names = np.array(m.languages, object)
        for batch in batches:
            letters = np.asarray(batch.column("letters").to_numpy(zero_copy_only=False), bool)
            for chunk in chunks(batch.column("text")):
                best, share, rate = _verdicts(m, slots, chunk)
                some = letters[chunk.rows.start : chunk.rows.stop]
                yield pa.record_batch(
                    {
                        "doc_id": batch.column("doc_id").slice(chunk.rows.start, chunk.n),
                        "lang_pred": pa.array(np.where(some, names[best], UNDETERMINED), pa.string()),
                        "score": pa.array(np.where(some, share, 0.0)),
                        "bits_per_byte": pa.array(rate, mask=~some),
                    }
                )

    return rows.mapInArrow(score, "doc_id long, lang_pred string, score double, bits_per_byte double")


def _ready(m: Model) -> tuple[Model, np.ndarray]:
    m.levels[ORDER] = (m.levels[ORDER][0], np.asfortranarray(m.levels[ORDER][1]))
    return m, m.index()


def _verdicts(m: Model, slots: np.ndarray, chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The best language's number, its share, and its bits a byte, for each document of a chunk."""
    bits = code_lengths(m, slots, chunk.data, chunk.offsets)
    best = bits.argmin(1)
    least = bits[np.arange(chunk.n), best]
    share = 1.0 / np.exp2(np.maximum(least[:, None] - bits, -1000.0)).sum(1)
    return best, share, least / np.maximum(np.diff(chunk.offsets), 1)


def determined(docs: DataFrame, model: Model | None = None, least: float = 0.5) -> DataFrame:
    """The documents, all columns as they were, without those that are ``und`` or whose best score is under ``least``."""
    model = model or train(docs)
    lettered = docs.where(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    if not model.languages:
        return lettered.limit(0)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, slots = _ready(held.value)
        for batch in batches:
            sure = np.zeros(batch.num_rows, bool)
            for chunk in chunks(batch.column("text")):
                sure[chunk.rows.start : chunk.rows.stop] = _verdicts(m, slots, chunk)[1] >= least
            yield batch.filter(pa.array(sure))

    return lettered.mapInArrow(keep, docs.schema)


def op8_partial_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = identify(documents(spark, sf_dir))
    return got.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score", "bits_per_byte")
