"""Text files that come in parts: ``name.part-aa``, ``name.part-ab``, ... make one stream, gzipped or not.

A compressed stream can only be read from its start, so one task reads one file, part after part, and holds no more than a
part and some lines; several files are read side by side. Files without parts are read as they are. What is not whole is
refused: a gap in the suffixes, an empty part, another length than expected, a gzip stream that ends early.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbolex.session import ship

PIECE = 1 << 20


class Incomplete(ValueError):
    pass


def found(spark: SparkSession, base: str) -> dict[int, int]:
    """The lengths of a file's parts by number: 0 for aa, 1 for ab, 26 for ba."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{base}.part-[a-z][a-z]")
    listed = place.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(place) or []
    number = lambda name: (ord(name[-2]) - 97) * 26 + ord(name[-1]) - 97
    return {number(s.getPath().getName()): s.getLen() for s in listed}


def checked(parts: dict[int, int], base: str, length: int | None = None) -> None:
    """Refuses parts that are not all there: from aa on without a gap, none empty, of ``length`` bytes in all if given."""
    if gone := max(parts) + 1 - len(parts):
        raise Incomplete(f"{base}: {gone} parts are missing")
    if not min(parts.values()):
        raise Incomplete(f"{base}: a part is empty")
    if length is not None and sum(parts.values()) != length:
        raise Incomplete(f"{base}: {sum(parts.values())} bytes of {length}")


def _lines(parts: Iterator[bytes], name: str, zipped: bool) -> Iterator[list[str]]:
    """The lines of a stream, some at a time."""
    rest, inflate, begun = b"", None, False
    for part in parts:
        for lo in range(0, len(part), PIECE):
            data = part[lo : lo + PIECE]
            while data:
                out = data
                if zipped:
                    inflate = inflate or zlib.decompressobj(31)
                    out, begun = inflate.decompress(data, 8 * PIECE), True
                    data = inflate.unconsumed_tail or inflate.unused_data
                    if inflate.eof:  # another member may follow
                        inflate = None
                else:
                    data = b""
                *whole, rest = (rest + out).split(b"\n")
                if whole:
                    yield [x.decode("utf-8", "replace").removesuffix("\r") for x in whole]
    if zipped and (inflate is not None or not begun):
        raise Incomplete(f"{name}: the stream ends early")
    if rest:
        yield [rest.decode("utf-8", "replace").removesuffix("\r")]


def read_lines(spark: SparkSession, bases: list[str], lengths: dict[str, int] | None = None) -> DataFrame:
    """``value``: the lines of each file, from its parts where it has any; a name that ends in .gz is unzipped."""
    plain, split = [], None
    for base in bases:
        parts = found(spark, base)
        if not parts:
            plain.append(base)
            continue
        checked(parts, base, (lengths or {}).get(base))
        rows = spark.read.format("binaryFile").load(f"{base}.part-[a-z][a-z]")
        own = rows.select(F.lit(base).alias("base"), F.substring("path", -2, 2).alias("number"), "content")
        split = own if split is None else split.unionByName(own)
    out = spark.read.text(plain).select("value") if plain else None
    if split is None:
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((b, c.as_py()) for batch in batches for b, c in zip(batch.column(0).to_pylist(), batch.column(2)))
        ahead = next(rows, None)
        while ahead is not None:
            base = ahead[0]

            def own() -> Iterator[bytes]:
                nonlocal ahead
                while ahead is not None and ahead[0] == base:
                    yield ahead[1]
                    ahead = next(rows, None)

            for lines in _lines(own(), base, base.endswith(".gz")):
                yield pa.record_batch([pa.array(lines, pa.string())], names=["value"])

    ship(spark)
    got = split.repartition(len(bases), "base").sortWithinPartitions("base", "number").mapInArrow(run, "value string")
    return got if out is None else out.unionByName(got)
