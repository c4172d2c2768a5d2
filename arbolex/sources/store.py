"""The store: the vocabulary's tables as Parquet, written once, and opened with optional parts."""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass, field, replace

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbolex.operators import overlay, ranked, text, vector
from arbolex.session import recovered, swapped
from arbolex.sources import merging

SCHEMA_VERSION = "3"
SCHEMAS = {
    "notations": "notation string, notation_lc string, path array<string>, children array<string>, refs array<string>, base_notation string, key_id string, is_key_expanded boolean",
    "texts": "notation string, lang string, text string, ord long",
    "keywords": "notation string, lang string, keyword string, ord long",
    "counts": "collection_id string, notation string, count int",
    "info": "collection_id string, label string, counts_as_of string, total_notations int, search_url_template string",
    "embeddings": "notation string, embedding array<tinyint>",
    "meta": "key string, value string",
}
COUNTS_KEY, SUMS_KEY = ["notation", "collection_id"], ["name", "kind"]
INDEX = "notation string, notation_lc string, lang string, ord long, padded string, n_tokens int"
POSTINGS_A_BUCKET, MOST_BUCKETS = 1_000_000, 50_000  # about what one task sorts in memory


@dataclass
class Vocabulary:
    """The tables of one vocabulary; missing optional ones are empty."""

    notations: DataFrame
    texts: DataFrame
    keywords: DataFrame
    counts: DataFrame
    info: DataFrame
    embeddings: DataFrame
    meta: DataFrame
    label_index: DataFrame
    keyword_index: DataFrame
    sums: DataFrame
    clusters: DataFrame | None = None  # of the vectors, where the store has them
    missing: list[str] = field(default_factory=list)
    postings: dict[str, ranked.Postings] = field(default_factory=dict)  # by index

    def searchers(self) -> list[DataFrame | text.Searcher]:
        """The two text indexes, as postings where the store has them."""
        return [self.postings[n].searcher() if n in self.postings else getattr(self, n) for n in INDEXES]


INDEXES = {"label_index": "texts", "keyword_index": "keywords"}


def _empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def vocabulary(spark: SparkSession, **tables: DataFrame) -> Vocabulary:
    """A vocabulary of DataFrames; the token indexes are made where they are not given."""
    missing = [k for k in SCHEMAS if k not in tables]
    t = {k: tables.get(k, _empty(spark, s)) for k, s in SCHEMAS.items()}
    for name in ("notations", "embeddings"):
        if "notation_lc" not in t[name].columns:
            t[name] = t[name].withColumn("notation_lc", F.lower("notation"))
    own = {"texts": "text", "keywords": "keyword"}
    index = {n: tables.get(n) or text.token_table(t[of].withColumn("notation_lc", F.lower("notation")), own[of], "notation", "notation_lc", "lang", "ord") for n, of in INDEXES.items()}
    sums = tables.get("sums")
    return Vocabulary(**t, **index, sums=overlay.sums(t["counts"], t["notations"]) if sums is None else sums, clusters=tables.get("clusters"), missing=missing, postings=tables.get("postings") or {})


def write(v: Vocabulary, path: str) -> None:
    """Writes all tables. Codes are range-partitioned and sorted, so that prefix filters skip row groups; the token
    indexes are tokenised once, here."""
    order = {"notations": "notation_lc", "texts": "notation", "keywords": "notation", "label_index": "notation_lc", "keyword_index": "notation_lc"}
    for name in (*SCHEMAS, *INDEXES):
        if name in v.missing:
            continue
        df = getattr(v, name)
        if name == "counts":  # changed later by key, and its sums with it
            _renewed(df, f"{path}/counts", COUNTS_KEY)
            _renewed(v.sums, f"{path}/sums", SUMS_KEY)
            continue
        if name == "embeddings":
            _write_vectors(df, path)
            continue
        if key := order.get(name):
            df = df.repartitionByRange(key).sortWithinPartitions(key)
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    for name, of in INDEXES.items():
        if of in v.missing:
            continue
        write_postings(v.notations.sparkSession.read.parquet(f"{path}/{name}"), f"{path}/{name}")


def _write_vectors(df: DataFrame, path: str) -> None:
    """Vectors by cluster, and the clusters beside them: a search reads those that may hold a near one."""
    at = vector.centres(df)
    if not len(at):
        df.write.mode("overwrite").parquet(f"{path}/embeddings")
        return
    rows = vector.clustered(df, at).repartitionByRange("cluster", "notation_lc").sortWithinPartitions("cluster", "notation_lc")
    rows.write.mode("overwrite").parquet(f"{path}/embeddings")
    vector.cluster_table(df.sparkSession.read.parquet(f"{path}/embeddings"), at).coalesce(1).write.mode("overwrite").parquet(f"{path}/clusters")


def _clusters(spark: SparkSession, path: str, vectors: DataFrame) -> DataFrame | None:
    """The clusters, if they are those of all stored vectors; others would make a search miss some."""
    try:
        known = spark.read.parquet(f"{path}/clusters")
        return known if "cluster" in vectors.columns and (known.agg(F.sum("n")).first()[0] or 0) == vectors.where("embedding is not null").count() else None
    except AnalysisException:
        return None


def _renewed(df: DataFrame, path: str, key: list[str]) -> None:
    spark = df.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if merging.head(spark, path) is None and fs.exists(place):  # of another layout
        fs.delete(place, True)
    merging.create(df, path, key)


def upsert_counts(spark: SparkSession, path: str, new: DataFrame) -> None:
    """Rows of a stored overlay replaced or added by collection and code. Deltas are written, of the rows and of the sums
    that they change; nothing else of the overlay is read or written anew but the sums of these codes."""
    path = recovered(spark, path)
    new = new.select(*(c.split()[0] for c in SCHEMAS["counts"].split(", "))).dropDuplicates(COUNTS_KEY)
    if merging.head(spark, f"{path}/counts") is None:
        merging.create(new, f"{path}/counts", COUNTS_KEY)
        merging.create(overlay.sums(new, spark.read.parquet(f"{path}/notations")), f"{path}/sums", SUMS_KEY)
        return
    changed = overlay.changed_sums(merging.read(spark, f"{path}/sums", SUMS_KEY), new, spark.read.parquet(f"{path}/notations"))
    merging.merge(spark, f"{path}/sums", changed, SUMS_KEY)
    merging.merge(spark, f"{path}/counts", new, COUNTS_KEY)


def compact_counts(spark: SparkSession, path: str) -> None:
    """Folds the overlay's deltas into the ranges that they touch."""
    path = recovered(spark, path)
    for name, key in (("counts", COUNTS_KEY), ("sums", SUMS_KEY)):
        merging.compact(spark, f"{path}/{name}", key)
        merging.cleaned(spark, f"{path}/{name}")


def write_postings(table_: DataFrame, path: str) -> None:
    """The postings of a stored token table beside it: bucketed by text, and sorted by token and block inside a bucket, in
    small pages, so that a query reads its own tokens' blocks. ``read_postings`` opens them, in any session.

    Only texts are shuffled, once by text and once by block, never postings: each time those of a text are made where it
    comes to lie, so that a block's sums leave one task."""
    spark = table_.sparkSession
    sums = ranked.statistics(table_)
    n = int(table_.agg(F.sum("n_tokens")).first()[0] or 0)
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(MOST_BUCKETS, -(-n // POSTINGS_A_BUCKET)))
    sums.withColumn("_buckets", F.lit(buckets)).coalesce(1).write.mode("overwrite").parquet(f"{path}_statistics")
    name = f"arbolex_{uuid.uuid4().hex}"  # bucketed files are written through the catalogue; dropping the table leaves them
    texts = ranked.numbered(table_)
    rows = ranked.index(texts.repartition(buckets, "doc"))
    rows.write.mode("overwrite").option("compression", "zstd").bucketBy(buckets, "doc").sortBy("token", "block", "doc").option("path", f"{path}_postings").option("parquet.page.row.count.limit", 2000).saveAsTable(name)
    spark.sql(f"DROP TABLE {name}")
    blocks = ranked.block_table(texts, sums, buckets).sortWithinPartitions("token", "block")
    blocks.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}_blocks")
    totals = ranked.token_totals(spark.read.parquet(f"{path}_blocks"))
    totals.repartitionByRange("token").sortWithinPartitions("token").write.mode("overwrite").parquet(f"{path}_tokens")


def read_postings(spark: SparkSession, path: str) -> ranked.Postings:
    """The postings beside a stored token table. The session's catalogue tells Spark how they are bucketed."""
    sums = spark.read.parquet(f"{path}_statistics")
    buckets = sums.first()["_buckets"]
    files = f"{path}_postings"
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(files).schema.fields)
    name = f"arbolex_{hashlib.sha256(files.encode()).hexdigest()[:32]}"
    place = files.replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (doc) SORTED BY (token, block, doc) INTO {buckets} BUCKETS LOCATION '{place}'")
    return ranked.Postings(spark.table(name), spark.read.parquet(f"{path}_blocks"), spark.read.parquet(f"{path}_tokens"), sums.drop("_buckets"))


def stamped(v: Vocabulary, built_at: str, source: str = "", dimensions: int | None = None) -> Vocabulary:
    """``v`` with its version rows: when and from what it was built, how many codes of each kind and vectors it has, in
    which languages, and the layout. Rows that it has already stay, unless they are of these keys."""
    spark = v.notations.sparkSession
    n = v.notations.agg(F.count(F.lit(1)).alias("n"), F.count_if("is_key_expanded").alias("k")).first()
    langs = lambda df: ",".join(sorted(r["lang"] for r in df.select("lang").distinct().collect()))
    rows = {"built_at": built_at, "source": source, "notation_count": n["n"], "base_notation_count": n["n"] - n["k"], "key_expanded_count": n["k"], "text_languages": langs(v.texts), "keyword_languages": langs(v.keywords), "schema_version": SCHEMA_VERSION}
    if "embeddings" not in v.missing:
        rows["embedding_count"] = v.embeddings.count()
    if dimensions is not None:
        rows["embedding_dimensions"] = dimensions
    rows = metadata(v) | {k: str(x) for k, x in rows.items()}
    return replace(v, meta=spark.createDataFrame(sorted(rows.items()), SCHEMAS["meta"]), missing=[m for m in v.missing if m != "meta"])


def upsert(spark: SparkSession, path: str, new: DataFrame, key: list[str]) -> None:
    """Rows of a stored table replaced or added by key: written beside the table, and then put in its place."""
    try:
        old = spark.read.parquet(recovered(spark, path)).select(*new.columns)
        both = old.join(new.select(*key).distinct(), key, "left_anti").unionByName(new)
    except AnalysisException:
        both = new
    both.write.mode("overwrite").parquet(f"{path}.tmp")
    swapped(spark, f"{path}.tmp", path)


def publish(v: Vocabulary, path: str) -> bool:
    """Replaces the store at ``path`` by ``v``: written beside it, read back and checked, and only then put in its place.
    If that fails the old store stays as it was, and what was staged is removed. Should the caller be lost between the two
    renames, ``open_store`` opens the old store from where it was moved to. Says whether ``v`` is in place."""
    spark = v.notations.sparkSession
    staged = f"{path.rstrip('/')}.staged"
    place = spark._jvm.org.apache.hadoop.fs.Path(staged)
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(place, True)
    try:
        write(v, staged)
        whole = not open_store(spark, staged).notations.isEmpty()
    except (PySparkException, Py4JJavaError):
        whole = False
    if whole and swapped(spark, staged, path):
        return True
    fs.delete(place, True)
    return False


def open_store(spark: SparkSession, path: str) -> Vocabulary:
    """Opens a store. notations and texts must be there; an overlay or embeddings that are absent or of another layout are
    left out, and what depends on them is empty."""
    path = recovered(spark, path)
    got = {}
    for name, schema in SCHEMAS.items():
        try:
            kept = name == "counts" and merging.head(spark, f"{path}/{name}") is not None
            df = merging.read(spark, f"{path}/{name}", COUNTS_KEY) if kept else spark.read.parquet(f"{path}/{name}")
            if kept and merging.head(spark, f"{path}/sums") is not None:
                got["sums"] = merging.read(spark, f"{path}/sums", SUMS_KEY)
            want = [c.split()[0] for c in schema.split(", ")]
            if set(want) <= set(df.columns):
                got[name] = df.select(*want, *(c for c in ("notation_lc", "cluster") if name == "embeddings" and c in df.columns))
                if name == "embeddings":
                    got["clusters"] = _clusters(spark, path, df)
        except AnalysisException:
            if name in ("notations", "texts"):
                raise
    for name in INDEXES:
        try:
            table_ = spark.read.parquet(f"{path}/{name}")
            if {c.split()[0] for c in INDEX.split(", ")} <= set(table_.columns):
                got[name] = table_
                got.setdefault("postings", {})[name] = read_postings(spark, f"{path}/{name}")
        except AnalysisException:
            pass
    v = vocabulary(spark, **got)
    if "embeddings" not in v.missing and not counts_agree(metadata(v).get("embedding_count"), v.embeddings):
        v = vocabulary(spark, **{k: x for k, x in got.items() if k not in ("embeddings", "clusters")})
    return v


def counts_agree(expected: str | None, embeddings: DataFrame) -> bool:
    """Whether a store has all its vectors; a number that is unknown, or none, is trusted. Without them a search by
    meaning would silently miss codes, so such a store is opened without vectors."""
    try:
        return vector.counts_agree(float(expected) if expected is not None else None, embeddings.count())
    except ValueError:
        return True


def metadata(v: Vocabulary) -> dict[str, str]:
    """A few rows, as a dict."""
    return {r["key"]: r["value"] for r in v.meta.collect()}


def resume(wanted: DataFrame, *tables: DataFrame, key: str = "notation") -> DataFrame:
    """What is still to do: rows whose key is not yet in every one of the tables."""
    done = tables[0].select(key)
    for t in tables[1:]:
        done = done.intersect(t.select(key))
    return wanted.join(done, key, "left_anti")


def export_counts(counts: DataFrame, path: str) -> None:
    """notation,count as one CSV file with a header; a result, not a corpus."""
    counts.coalesce(1).write.mode("overwrite").csv(path, header=True)
