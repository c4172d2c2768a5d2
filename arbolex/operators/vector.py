"""Vectors: normalising, truncating, quantising to int8, exact cosine top-k with filters before the top-k."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arbolex.session import ship

def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def normalized(v: Column) -> Column:
    n = F.greatest(norm(v), F.lit(1e-10))
    return F.transform(v, lambda x: x.cast("double") / n)


def truncated(v: Column, dim: int) -> Column:
    """The first ``dim`` values at unit norm; a vector that is no longer stays as it is, as does any for dim <= 0."""
    if dim <= 0:
        return F.transform(v, lambda x: x.cast("double"))
    return F.when(F.size(v) <= dim, F.transform(v, lambda x: x.cast("double"))).otherwise(normalized(F.slice(v, 1, dim)))


def quantized(v: Column) -> Column:
    """Stored vectors: values times 127, clipped, cut to int8."""
    return F.transform(v, lambda x: F.greatest(F.lit(-127.0), F.least(F.lit(127.0), x.cast("double") * 127)).cast("tinyint"))


def quantized_query(v: Column) -> Column:
    """Query vectors: [-1, 1] spread over the whole int8 range."""
    return F.transform(v, lambda x: ((x.cast("double") + 1) * 127.5 - 128).cast("tinyint"))


def quantize_query(v: list[float]) -> list[int]:
    """The same on the driver, of a vector normalised first."""
    n = max(math.sqrt(sum(x * x for x in v)), 1e-10)
    return [max(-128, min(127, math.trunc((x / n + 1) * 127.5 - 128))) for x in v]


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("long") * y.cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cos of two int8 vectors, from exact integer sums."""
    return 1 - dot(a, b) / F.sqrt(dot(a, a).cast("double") * dot(b, b).cast("double"))


def similarity(distance: Column) -> Column:
    """Rounded to 3 places, half up."""
    return F.floor((1 - distance) * 1000 + 0.5) / 1000


def nearest(vectors: DataFrame, key: str, query: list[int], k: int, keep: DataFrame | None = None, scope: Column | None = None) -> DataFrame:
    """The k nearest of the int8 column ``embedding``. Scope and the keys in ``keep`` filter before the top-k, so that it is
    always full; ties go to the smaller key. Only k rows leave each task."""
    rows = vectors if scope is None else vectors.where(scope)
    if keep is not None:
        rows = rows.join(keep.select(key).distinct(), key, "left_semi")
    return distances(rows, key, query, k).orderBy("distance", key).limit(k)


def distances(rows: DataFrame, key: str, query: list[int], k: int | None = None) -> DataFrame:
    """key and the cosine distance of its vector to the query, by one product of matrix and vector for each Arrow batch; with
    ``k`` only the nearest k of a batch, and what ties with the last of them."""
    q = np.array(query, np.int64)
    own = float(q @ q)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            flat, at = batch.column(1).flatten(), np.diff(np.asarray(batch.column(1).offsets))
            if (at != len(q)).any():
                raise ValueError(f"a vector has not the {len(q)} dimensions of the query")
            m = np.asarray(flat).reshape(-1, len(q)).astype(np.int64)
            with np.errstate(divide="ignore", invalid="ignore"):
                far = 1 - (m @ q) / np.sqrt((m * m).sum(1).astype(np.float64) * own)
            keep = slice(None)
            if k is not None and len(far) > k:
                last = np.partition(far, k - 1)[k - 1]
                keep = np.flatnonzero(~(far > last))
            yield pa.record_batch([batch.column(0).take(pa.array(np.arange(len(far))[keep])), pa.array(far[keep])], names=[key, "distance"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, "embedding").where("embedding is not null").mapInArrow(run, f"`{key}` {kind}, distance double")


def nearest_then_kept(vectors: DataFrame, key: str, query: list[int], k: int, keep: DataFrame | None = None, scope: Column | None = None, most: int = 4096) -> DataFrame:
    """The same with the keys in ``keep`` as a filter after the top-k, which takes 5 times k rows within a scope and 20
    times k elsewhere, ``most`` at most; it may give fewer than k."""
    if keep is None:
        return nearest(vectors, key, query, min(k, most), None, scope)
    wide = nearest(vectors, key, query, min(k * (5 if scope is not None else 20), most), None, scope)
    return wide.join(keep.select(key).distinct(), key, "left_semi").orderBy("distance", key).limit(k)


# Many queries at a time, and clusters that a query can leave out

CLUSTER_ROWS, MOST_CLUSTERS, SAMPLE_A_CLUSTER, ROUNDS = 256, 4096, 16, 4
BLOCK = 512  # vectors that meet all centres at a time
SLAB, LEAST_SLAB, STRIP = 1 << 17, 1024, 4096  # vectors of a slab at most and at least, and those compared at a time
PROBES = 16  # vectors of each cluster that bound how far a query's nearest are
_SLACK = 1e-7  # of angles, for rounding


def _matrix(column: pa.Array) -> np.ndarray:
    sizes = np.diff(np.asarray(column.offsets))
    if len(sizes) and (sizes != sizes[0]).any():
        raise ValueError("vectors of unlike dimensions")
    return np.asarray(column.flatten()).reshape(len(sizes), -1).astype(np.float64)


def _units(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.sqrt((m * m).sum(axis=1, keepdims=True)), 1e-12)


def _angles(cosines: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosines, -1, 1))


def _nearest_centre(units: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each unit vector its nearest centre and the cosine, in blocks: never the whole matrix of vectors and centres."""
    own, cosine = np.zeros(len(units), np.int64), np.zeros(len(units))
    for lo in range(0, len(units), BLOCK):
        near = units[lo : lo + BLOCK] @ at.T
        own[lo : lo + BLOCK] = near.argmax(axis=1)
        cosine[lo : lo + BLOCK] = near[np.arange(len(near)), own[lo : lo + BLOCK]]
    return own, cosine


def centres(vectors: DataFrame, clusters: int | None = None) -> np.ndarray:
    """Unit centres of clusters, found on a bounded sample: SAMPLE_A_CLUSTER vectors a cluster. How good they are only
    decides how much a query can leave out."""
    n = vectors.count()
    clusters = clusters or max(1, min(MOST_CLUSTERS, n // CLUSTER_ROWS))
    rows = vectors.where("embedding is not null").select("embedding").sample(min(1.0, 2 * SAMPLE_A_CLUSTER * clusters / max(n, 1)), seed=7).limit(SAMPLE_A_CLUSTER * clusters)
    drawn = rows.toArrow().column(0).combine_chunks()
    if not len(drawn):
        return np.zeros((0, 0))
    x = _units(_matrix(drawn))
    rng = np.random.default_rng(7)
    at = x[rng.choice(len(x), min(clusters, len(x)), replace=False)]
    for _ in range(ROUNDS):
        own = _nearest_centre(x, at)[0]
        sums = np.zeros_like(at)
        np.add.at(sums, own, x)
        some = np.sqrt((sums * sums).sum(axis=1)) > 1e-9
        at[some] = _units(sums[some])
    return at


def clustered(vectors: DataFrame, at: np.ndarray) -> DataFrame:
    """Adds cluster, the nearest of the centres, and angle, how far from it the vector is."""
    ship(vectors.sparkSession)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema.fields if f.name not in ("cluster", "angle"))
    names = [c for c in vectors.columns if c not in ("cluster", "angle")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                own, cosine = _nearest_centre(_units(_matrix(batch.column(names.index("embedding")))), at)
                yield pa.record_batch([*batch.columns, pa.array(own.astype(np.int32)), pa.array(_angles(cosine))], names=[*names, "cluster", "angle"])

    return vectors.select(*names).where("embedding is not null").mapInArrow(run, f"{schema}, cluster int, angle double")


def cluster_table(rows: DataFrame, at: np.ndarray) -> DataFrame:
    """cluster, centre, radius (the largest angle between the centre and a vector) and n; MOST_CLUSTERS rows at most."""
    known = rows.sparkSession.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(at)], "cluster int, centre array<double>")
    return rows.groupBy("cluster").agg(F.max("angle").alias("radius"), F.count(F.lit(1)).alias("n")).join(F.broadcast(known), "cluster")


def nearest_many(vectors: DataFrame, key: str, queries: dict[str, list[int]], k: int, clusters: DataFrame | None = None, keep: DataFrame | None = None, scope: Column | None = None) -> DataFrame:
    """query, key and distance: what ``nearest`` gives for each of the int8 queries, which are as many as fit the driver
    (``nearest_each`` takes a table of them), in one scan: a matrix product for each Arrow batch, and at most k rows a query leave a task.

    With ``clusters`` (of vectors that have a column cluster) whole clusters are left out, exactly: an angle to a vector is
    at least that to its centre less the cluster's radius. The nearest clusters are read first, to know how near k vectors
    are at least; then, in one pass, those that may hold a nearer one for any query."""
    names, q = list(queries), np.array(list(queries.values()), np.float64)
    rows = vectors if scope is None else vectors.where(scope)
    if keep is not None:
        rows = rows.join(keep.select(key).distinct(), key, "left_semi")
    kind = rows.schema[key].dataType.simpleString()
    if not names or k < 1:
        return vectors.sparkSession.createDataFrame([], f"query string, `{key}` {kind}, distance double")
    ranked = lambda df: df.withColumn("_place", F.row_number().over(Window.partitionBy("query").orderBy("distance", key))).where(F.col("_place") <= k).drop("_place")
    if clusters is None:
        return ranked(_scanned(rows, key, kind, names, q, k, None, None))
    ids, asked = clusters_asked(rows, key, names, q, k, clusters)
    some = [int(c) for c in ids[asked.any(axis=0)]]
    return ranked(_scanned(rows.where(F.col("cluster").isin(some)), key, kind, names, q, k, ids, asked))


def nearest_each(vectors: DataFrame, key: str, queries: DataFrame, k: int, clusters: DataFrame) -> DataFrame:
    """What ``nearest_many`` gives, for a table of queries (query, embedding) of any size: none of them reaches the driver,
    which holds the clusters and PROBES vectors of each.

    The k-th distance to the vectors drawn from a query's nearest clusters bounds its search: clusters that the bound and
    their radius rule out are left out, exactly. Vectors are dealt by cluster to slabs, a large cluster to several, and
    queries go to the slabs that they ask. Of each slab a query brings back k rows at most, and the best k of these stay."""
    spark = vectors.sparkSession
    ship(spark)
    vectors = vectors.where("embedding is not null").select(key, "embedding", "cluster")
    kind = vectors.schema[key].dataType.simpleString()
    known = clusters.orderBy("cluster").toArrow()
    if k < 1 or not known.num_rows:
        return spark.createDataFrame([], f"query string, `{key}` {kind}, distance double")
    size = known["n"].to_numpy()
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    first, slices = _slabs(size, max(LEAST_SLAB, min(SLAB, -(-int(size.sum()) // math.isqrt(tasks)))))
    slabs = int((first + slices).max())
    blocks = max(1, -(-tasks // slabs))  # of queries, so that each task has a share
    order = F.row_number().over(Window.partitionBy("cluster").orderBy(F.xxhash64(key), key))
    drawn = vectors.withColumn("_place", order).where(F.col("_place") <= PROBES).select("cluster", "embedding").orderBy("cluster").toArrow()
    ids = known["cluster"].to_numpy()
    held = spark.sparkContext.broadcast({
        "ids": ids, "centres": _matrix(known["centre"].combine_chunks()), "radius": known["radius"].to_numpy(), "first": first, "slices": slices,
        "probes": _matrix(drawn["embedding"].combine_chunks()).astype(np.int8), "edge": np.searchsorted(drawn["cluster"].to_numpy(), np.append(ids, ids[-1] + 1)),
    })

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(lo, BLOCK)
                limit, asked = _routed(_matrix(batch.column(1)), k, held.value)
                counts = np.array([len(a) for a in asked])
                slab = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(np.concatenate(asked).astype(np.int32)))
                yield pa.record_batch([batch.column(0), batch.column(1), pa.array(limit), slab], names=["query", "embedding", "bound", "slabs"])

    asking = queries.where("embedding is not null").select(F.col("query").cast("string").alias("query"), "embedding")
    routed = asking.mapInArrow(route, "query string, embedding array<tinyint>, bound double, slabs array<int>")
    routed = routed.select("query", "embedding", "bound", F.explode("slabs").alias("slab"))
    cell = lambda slab, block: (slab.cast("long") * blocks + block).alias("cell")
    nothing = lambda name, type_: F.lit(None).cast(type_).alias(name)
    asks = routed.select(cell(F.col("slab"), F.pmod(F.xxhash64("query"), F.lit(blocks))), F.lit(True).alias("asks"), nothing("cluster", "int"), nothing(key, kind), "embedding", "query", "bound")
    at = F.broadcast(spark.createDataFrame([(int(c), int(f), int(s)) for c, f, s in zip(ids, first, slices)], "cluster int, _first int, _slices int"))
    dealt = vectors.join(at, "cluster").withColumn("_slab", F.col("_first") + F.pmod(F.xxhash64(key), F.col("_slices"))).withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    dealt = dealt.select(cell(F.col("_slab"), F.col("_block")), F.lit(False).alias("asks"), "cluster", key, "embedding", nothing("query", "string"), nothing("bound", "double"))
    met = dealt.unionByName(asks).repartition(tasks, "cell").sortWithinPartitions("cell", "asks", "cluster", key)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held_rows, slab = None, [], None
        for whole in batches:
            cells = whole.column("cell").to_numpy()
            edge = np.concatenate([[0], np.flatnonzero(cells[1:] != cells[:-1]) + 1, [len(cells)]]) if len(cells) else []
            for lo, hi in zip(edge[:-1], edge[1:]):
                part = whole.slice(lo, hi - lo)
                if cells[lo] != now:
                    now, held_rows, slab = cells[lo], [], None
                ask = int(np.searchsorted(part.column("asks").to_numpy(zero_copy_only=False), True))
                if ask:
                    held_rows.append(part.slice(0, ask).select(["cluster", key, "embedding"]))
                if not held_rows:
                    continue  # queries of a slab without vectors
                for at in range(ask, part.num_rows, BLOCK):
                    slab = slab or _Slab(pa.Table.from_batches(held_rows).combine_chunks(), held.value)
                    some = part.slice(at, BLOCK)
                    c, row, far = slab.nearest(_matrix(some.column("embedding")), some.column("bound").to_numpy(), k)
                    yield pa.record_batch([some.column("query").take(pa.array(c)), slab.keys.take(pa.array(row)), pa.array(far)], names=["query", key, "distance"])

    found = met.mapInArrow(search, f"query string, `{key}` {kind}, distance double")
    place = F.row_number().over(Window.partitionBy("query").orderBy("distance", key))
    return found.withColumn("_place", place).where(F.col("_place") <= k).drop("_place")


def _slabs(size: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """For each cluster its first slab and over how many it goes: clusters in turn, about ``most`` vectors a slab."""
    first, slices = np.zeros(len(size), np.int64), np.ones(len(size), np.int64)
    slab, filled = 0, 0
    for c, n in enumerate(size.tolist()):
        if filled and filled + n > most:
            slab, filled = slab + 1, 0
        first[c], slices[c] = slab, max(1, -(-n // most))
        filled += n
        if n > most:
            slab, filled = slab + int(slices[c]), 0
    return first, slices


def _far(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Distances of the vectors x (rows) to the queries q (columns), as ``distances`` gives them."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return 1 - (x @ q.T) / np.sqrt((x * x).sum(axis=1)[:, None] * (q * q).sum(axis=1))


def _routed(q: np.ndarray, k: int, known: dict) -> tuple[np.ndarray, list[np.ndarray]]:
    """For each query a bound of its k-th distance (inf: none), and the slabs that it asks."""
    if q.shape[1] != known["centres"].shape[1]:
        raise ValueError(f"a vector has not the {q.shape[1]} dimensions of the query")
    far, edge = _angles(_units(q) @ known["centres"].T), known["edge"]
    some = min(far.shape[1], -(-max(k, 4 * PROBES) // PROBES))
    limit, asked = np.full(len(q), np.inf), []
    for i, row in enumerate(far):
        close = np.argpartition(row, some - 1)[:some]
        x = np.concatenate([known["probes"][edge[c] : edge[c + 1]] for c in close]).astype(np.float64)
        d = _far(x, q[i : i + 1])[:, 0]
        d = d[d == d]
        if len(d) >= k:
            limit[i] = np.partition(d, k - 1)[k - 1]
        use = np.flatnonzero(row - known["radius"] - _SLACK <= _limit_angle(limit[i]))
        asked.append(np.unique(np.concatenate([np.arange(known["first"][c], known["first"][c] + known["slices"][c]) for c in use])))
    return limit, asked


def _limit_angle(distance: np.ndarray | float) -> np.ndarray:
    """The angle of a bound, with room for rounding; any angle where there is none."""
    return np.where(np.isfinite(distance), _angles(1 - np.minimum(distance, 3)) + _SLACK, 2 * np.pi)


class _Slab:
    """Vectors of a slab, sorted by cluster and key, and their search by blocks of queries."""

    def __init__(self, rows: pa.Table, known: dict) -> None:
        self.keys = rows[rows.column_names[1]].combine_chunks()
        if isinstance(self.keys, pa.ChunkedArray):
            self.keys = pa.concat_arrays(self.keys.chunks)
        self.x = np.concatenate([_matrix(c).astype(np.int8) for c in rows["embedding"].chunks])
        self.rank = np.zeros(len(self.x), np.int64)
        self.rank[pc.sort_indices(self.keys).to_numpy()] = np.arange(len(self.x))
        cluster = rows["cluster"].to_numpy()
        edge = np.concatenate([[0], np.flatnonzero(cluster[1:] != cluster[:-1]) + 1, [len(cluster)]])
        self.runs = list(zip(edge[:-1].tolist(), edge[1:].tolist()))
        own = np.searchsorted(known["ids"], cluster[edge[:-1]])
        self.centres, self.radius = known["centres"][own], known["radius"][own]

    def nearest(self, q: np.ndarray, bound: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query, row and distance of the k nearest of each query, without what lies beyond its bound or in clusters that it rules out."""
        if self.x.shape[1] != q.shape[1]:
            raise ValueError(f"a vector has not the {q.shape[1]} dimensions of the query")
        unit, cut = _units(q).astype(np.float32), bound.copy()
        slack = 1e-6 * q.shape[1]  # of cosines in single precision
        asked = _angles(_units(q) @ self.centres.T) - self.radius - _SLACK <= _limit_angle(bound)[:, None]
        best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        for run, (begin, end) in enumerate(self.runs):
            of = np.flatnonzero(asked[:, run])
            for lo in range(begin, end, STRIP) if len(of) else ():
                x = self.x[lo : min(lo + STRIP, end)].astype(np.float64)
                may = _units(x).astype(np.float32) @ unit[of].T >= (1 - cut[of] - slack).astype(np.float32)
                crowded = may.sum(axis=0) > 4 * k
                r, c = np.nonzero(may & ~crowded)
                with np.errstate(divide="ignore", invalid="ignore"):
                    far = 1 - (x[r] * q[of[c]]).sum(axis=1) / np.sqrt((x[r] * x[r]).sum(axis=1) * (q[of[c]] * q[of[c]]).sum(axis=1))
                new = [(of[c], lo + r, far)]
                if crowded.any():  # the k nearest of the strip, of equal ones the first
                    of_ = of[crowded]
                    far = _far(x, q[of_])
                    by = np.where(np.isnan(far), 4.0, far)
                    last = np.partition(by, k - 1, axis=0)[k - 1]
                    ties = by == last
                    r, c = np.nonzero((by < last) | (ties & (np.cumsum(ties, axis=0) <= k)))
                    new.append((of_[c], lo + r, far[r, c]))
                if not any(len(n[0]) for n in new):
                    continue
                both = [np.concatenate(z) for z in zip(best, *new)]
                order = np.lexsort((self.rank[both[1]], both[2], both[0]))  # nan comes last
                c, row, far = (z[order] for z in both)
                place = np.arange(len(c)) - np.searchsorted(c, c)
                best = tuple(z[place < k] for z in (c, row, far))
                full = np.flatnonzero((place == k - 1) & (far == far))
                cut[c[full]] = np.minimum(cut[c[full]], far[full])
        return best


def clusters_asked(rows: DataFrame, key: str, names: list[str], q: np.ndarray, k: int, clusters: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The clusters' ids, and for each query (a row) which of them may hold one of its k nearest."""
    kind = rows.schema[key].dataType.simpleString()
    known = clusters.collect()
    ids = np.array([c["cluster"] for c in known], np.int64)
    far = _angles(_units(q) @ np.array([c["centre"] for c in known], np.float64).reshape(len(known), -1).T)
    near = np.maximum(far - np.array([c["radius"] for c in known]), 0) - _SLACK  # the least angle that a cluster allows
    size = np.array([c["n"] for c in known])
    first: set[int] = set()
    for row in far:
        order = np.argsort(row, kind="stable")
        first.update(order[: int(np.searchsorted(np.cumsum(size[order]), k)) + 1].tolist())
    limit = np.full(len(names), np.pi)
    begun = _scanned(rows.where(F.col("cluster").isin([int(ids[c]) for c in first])), key, kind, names, q, k, None, None)
    place = F.row_number().over(Window.partitionBy("query").orderBy("distance", key))
    found = begun.withColumn("_place", place).where(F.col("_place") == k).select("query", "distance")
    for r in found.collect():  # a row a query
        if r["distance"] == r["distance"]:
            limit[names.index(r["query"])] = _angles(np.array([1 - r["distance"]]))[0] + _SLACK
    return ids, near <= limit[:, None]


def _scanned(rows: DataFrame, key: str, kind: str, names: list[str], q: np.ndarray, k: int, ids: np.ndarray | None, asked: np.ndarray | None) -> DataFrame:
    """At most k rows a task and query (with ``asked``: queries of each cluster in ``ids``)."""
    ship(rows.sparkSession)
    own = (q * q).sum(axis=1)
    columns = [key, "embedding", *(["cluster"] if ids is not None else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, last = None, np.full(len(names), np.nan)  # nan: fewer than k so far
        for batch in batches:
            if not batch.num_rows:
                continue
            m = _matrix(batch.column(1))
            if m.shape[1] != q.shape[1]:
                raise ValueError(f"a vector has not the {q.shape[1]} dimensions of the query")
            if ids is None:
                parts = [(np.arange(len(m)), np.arange(len(names)))]
            else:
                cluster = batch.column(2).to_numpy()
                parts = [(np.flatnonzero(cluster == c), np.flatnonzero(asked[:, int(np.flatnonzero(ids == c)[0])])) for c in np.unique(cluster)]
            for at, of in parts:
                if not len(of):
                    continue
                x = m[at]
                with np.errstate(divide="ignore", invalid="ignore"):
                    far = 1 - (x @ q[of].T) / np.sqrt((x * x).sum(axis=1)[:, None] * own[of])
                cut = last[of]
                if len(at) > k:
                    cut = np.fmin(cut, np.partition(far, k - 1, axis=0)[k - 1])
                r, c = np.nonzero(~(far > cut))
                new = pa.table({"query": pa.array(of[c], pa.int32()), key: batch.column(0).take(pa.array(at[r])), "distance": pa.array(far[r, c])})
                both = (new if best is None else pa.concat_tables([best, new])).sort_by([("query", "ascending"), ("distance", "ascending"), (key, "ascending")])
                of_row = both.column("query").to_numpy()
                begin = np.searchsorted(of_row, np.arange(len(names) + 1))
                place = np.arange(len(of_row)) - begin[of_row]
                best = both.take(pa.array(np.flatnonzero(place < k)))
                full = np.flatnonzero(np.diff(begin) >= k)
                last[full] = both.column("distance").to_numpy()[begin[full] + k - 1]
        if best is not None:
            for part in best.combine_chunks().to_batches():
                yield pa.record_batch([pa.array([names[i] for i in part.column(0).to_pylist()], pa.string()), part.column(1), part.column(2)], names=["query", key, "distance"])

    return rows.where("embedding is not null").select(*columns).mapInArrow(run, f"query string, `{key}` {kind}, distance double")


def validated(vectors: DataFrame, key: str, queries: dict[str, list[int]], k: int = 5) -> DataFrame:
    """query, the k nearest keys, and whether the nearest is that of a plain scan with SQL expressions."""
    out = None
    for name, q in queries.items():
        near = nearest(vectors, key, q, k).agg(F.array_sort(F.collect_list(F.struct("distance", key))).alias("_near"))  # k rows
        probe = F.array(*(F.lit(x).cast("tinyint") for x in q))
        plain = vectors.select(key, cosine_distance(F.col("embedding"), probe).alias("_d")).agg(F.min(F.struct("_d", key)).alias("_best"))
        row = near.crossJoin(plain).select(F.lit(name).alias("query"), F.transform("_near", lambda x: x[key]).alias("nearest"), (F.get("_near", F.lit(0))[key] == F.col("_best")[key]).alias("agrees"))
        out = row if out is None else out.unionByName(row)
    return out


def embedded(rows: DataFrame, embed: Callable[[list[str]], np.ndarray], key: str = "notation", text: str = "text", batch: int = 512) -> DataFrame:
    """key and the int8 ``embedding`` of each text. ``embed`` gives one row of floats for each of up to ``batch`` texts and
    runs where the rows are; a null text is embedded as an empty one. What is written so far needs no second run: pass
    only what is still to do (``store.resume``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, batch):
                part = whole.slice(lo, batch)
                v = np.asarray(embed([x or "" for x in part.column(1).to_pylist()]), np.float64)
                q = np.clip(v * 127, -127, 127).astype(np.int8)  # cut towards zero, as ``quantized`` does
                values = pa.ListArray.from_arrays(pa.array(np.arange(len(q) + 1) * q.shape[1], pa.int32()), pa.array(q.ravel()))
                yield pa.record_batch([part.column(0), values], names=[key, "embedding"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, text).mapInArrow(run, f"`{key}` {kind}, embedding array<tinyint>")


def agreement(a: DataFrame, b: DataFrame, k: int = 5, by: str = "query", key: str = "key") -> DataFrame:
    """How far two rankings (by, key, score; higher is better) agree: for each query, how many of the first k they share,
    and whether the first is the same. Queries of one side only share nothing. Ties go to the smaller key."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), key))
    first = lambda df, name: df.withColumn(name, place).where(F.col(name) <= k).select(by, key, name)
    both = first(a, "_a").join(first(b, "_b"), [by, key], "full")
    return both.groupBy(by).agg(F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("shared"), F.coalesce(F.bool_or((F.col("_a") == 1) & (F.col("_b") == 1)), F.lit(False)).alias("same_first"))


def counts_agree(expected: int | None, actual: int) -> bool:
    """Whether a store has all its vectors; an unknown number is trusted."""
    return expected is None or expected != expected or expected == actual
