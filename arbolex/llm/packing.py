"""Packing by first-fit decreasing with a tournament tree of bin capacities.

Each document becomes token ids plus the end id. Ids beyond the sequence length are cut off in whole sequences; the
remainders are packed first-fit decreasing, independently in randomised groups of documents (by a hash of doc_id). The
number of groups grows with the documents, so a group stays small whatever the input, and one hot source is spread over
all groups. In a group, the pieces of the emptiest last bins are then cut to fill the gaps that first-fit leaves.

Ids are those that the tokenizers library gives with the vocabulary file byte_bpe_50k.json as it is: a text that spells
one of its added tokens gets that token's id there. They are computed with the tiktoken library from the same
vocabulary's ranks, five times as fast, on what stands between added tokens; a text that it refuses goes through the
tokenizers library. A test holds the two against each other.

Defined cases: a null text is empty and gives the end id alone; equal or repeated rows are packed one by one, and rows
that agree in doc_id and text, and only those, always share a group; rows without a doc_id are spread by their text; an
empty table gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents

LENGTH = 2048
END_ID = 1
DOCS_A_GROUP = 1000
VOCABULARY, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
TOKENIZE_ROWS = 256


def _path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=1)
def _fast(ranks: str):
    import base64

    import public_tokenizers
    import tiktoken

    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})


@lru_cache(maxsize=1)
def _plain(vocabulary: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary)


@lru_cache(maxsize=1)
def _added(vocabulary: str) -> tuple[re.Pattern | None, dict[str, int], bool]:
    """The vocabulary's added tokens as a pattern, longest first, with their ids, and whether plain cuts at them are all
    that they do."""
    with open(vocabulary, encoding="utf-8") as f:
        tokens = json.load(f).get("added_tokens", [])
    ids = {t["content"]: t["id"] for t in tokens}
    plain = not any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in tokens)
    longest = sorted(ids, key=lambda x: (-len(x), x))
    return (re.compile("(" + "|".join(map(re.escape, longest)) + ")") if ids else None), ids, plain


def token_ids(text: str, vocabulary: str | None = None, ranks: str | None = None) -> list[int]:
    """The ids of one text, as the tokenizers library gives them without special tokens around it."""
    vocabulary = vocabulary or _path(VOCABULARY)
    added, ids, plain = _added(vocabulary)
    cuts = added is not None and added.search(text) is not None
    try:
        if not cuts:
            return _fast(ranks or _path(RANKS)).encode_ordinary(text)
        if plain:
            fast = _fast(ranks or _path(RANKS))
            return [i for k, piece in enumerate(added.split(text)) for i in ([ids[piece]] if k % 2 else fast.encode_ordinary(piece))]
    except BaseException as e:  # the library panics on some texts; its panics are no Exception
        if isinstance(e, (KeyboardInterrupt, SystemExit)):
            raise
    return _plain(vocabulary).encode(text, add_special_tokens=False).ids


class Bins:
    """First-fit over bins with a tournament tree: each node holds the largest room below it."""

    def __init__(self, n: int, room: int):
        self.leaves = 1 << max(1, (n - 1).bit_length())
        self.tree = [room] * (2 * self.leaves)

    def first(self, size: int) -> int:
        """Takes ``size`` from the first bin that has it and returns the bin."""
        tree, k = self.tree, 1
        while k < self.leaves:
            k *= 2
            if tree[k] < size:
                k += 1
        found = k - self.leaves
        tree[k] -= size
        k //= 2
        while k:
            top = max(tree[2 * k], tree[2 * k + 1])
            if tree[k] == top:
                break
            tree[k] = top
            k //= 2
        return found

    def room(self, k: int) -> int:
        return self.tree[self.leaves + k]


def first_fit_decreasing(sizes: list[int], length: int = LENGTH) -> list[list[tuple[int, int, int]]]:
    """Bins of (piece, start, size); a piece may be cut where the last bins fill the gaps of the others."""
    bins: list[list[tuple[int, int, int]]] = []
    tree = Bins(max(1, len(sizes)), length)
    for k in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        at = tree.first(sizes[k])
        if at == len(bins):
            bins.append([])
        bins[at].append((k, 0, sizes[k]))
    room = [length - sum(p[2] for p in b) for b in bins]
    gap, last = 0, len(bins) - 1
    while gap < last:  # the last bins hold the smallest load; their ids go into the gaps from the front
        if not room[gap]:
            gap += 1
        elif not bins[last]:
            bins.pop()
            last -= 1
        else:
            piece, start, size = bins[last].pop()
            put = min(size, room[gap])
            bins[gap].append((piece, start, put))
            room[gap] -= put
            room[last] += size
            if put < size:
                bins[last].append((piece, start + put, size - put))
                room[last] -= size - put
    return [b for b in bins if b]


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, length: int = LENGTH, end_id: int = END_ID, docs_a_group: int = DOCS_A_GROUP, vocabulary: str | None = None, ranks: str | None = None) -> DataFrame:
    """A row for each piece of a document: where it stands in the document and in which sequence, with its ids' CRC."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    groups = max(1, -(-rows.count() // docs_a_group))
    rows = rows.withColumn("grp", F.pmod(F.xxhash64("doc_id", "text", F.lit(7)), F.lit(groups)).cast("int"))
    # pandas makes floats of longs beside nulls, so an id travels as a number and whether there is one.
    rows = rows.select(F.col("doc_id").isNotNull().alias("named"), F.coalesce("doc_id", F.lit(0)).alias("doc_id"), "text", "grp")

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, TOKENIZE_ROWS):
                part = batch.slice(lo, TOKENIZE_ROWS)
                ids = [np.asarray([*token_ids(t or "", vocabulary, ranks), end_id], "<u4") for t in part.column("text").to_pylist()]
                # Whole sequences are settled here; only the ids of the remainders travel, in two bytes where they fit.
                crcs = [np.asarray([zlib.crc32(x[s : s + length]) for s in range(0, len(x) - length + 1, length)], "<u4") for x in ids]
                tails = [x[len(x) // length * length :] for x in ids]
                wide = [bool(len(x) and x.max() > 0xFFFF) for x in tails]
                yield pa.record_batch(
                    {
                        "named": part.column("named"),
                        "doc_id": part.column("doc_id"),
                        "grp": part.column("grp"),
                        "n": pa.array([len(x) for x in ids], pa.int64()),
                        "crcs": pa.array([x.tobytes() for x in crcs], pa.binary()),
                        "wide": pa.array(wide, pa.bool_()),
                        "tail": pa.array([(x if w else x.astype("<u2")).tobytes() for x, w in zip(tails, wide)], pa.binary()),
                    }
                )

    def pack_group(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["named", "doc_id", "n", "tail"], kind="stable")
        docs_, counts = [d if k else None for d, k in zip(pdf["doc_id"].tolist(), pdf["named"].tolist())], pdf["n"].tolist()
        tails = [np.frombuffer(x, "<u4" if w else "<u2").astype("<u4") for x, w in zip(pdf["tail"], pdf["wide"])]
        out, at = [], int(key[0]) << 32
        for k, crcs in enumerate(pdf["crcs"]):
            for j, crc in enumerate(np.frombuffer(crcs, "<u4").tolist()):
                out.append((docs_[k], j * length, length, crc, counts[k], at, 0))
                at += 1
        some = [k for k, x in enumerate(tails) if len(x)]
        for b in first_fit_decreasing([len(tails[k]) for k in some], length):
            offset = 0
            for p, s, n in b:
                k = some[p]
                out.append((docs_[k], counts[k] - len(tails[k]) + s, n, zlib.crc32(tails[k][s : s + n]), counts[k], at, offset))
                offset += n
            at += 1
        return pd.DataFrame({c.split()[0]: pd.array(x, dtype="Int64") for c, x in zip(PIECES.split(", "), zip(*out))})

    return rows.mapInArrow(tokenize, "named boolean, doc_id long, grp int, n long, crcs binary, wide boolean, tail binary").groupBy("grp").applyInPandas(pack_group, PIECES)


def op6_tournament_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))
