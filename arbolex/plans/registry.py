"""Named queries over the driver's tables and the SQL that must give the same rows.

The relational tables stand in for a vocabulary: parts are codes with suppliers as collections, documents are labels and
benchmark items keywords, regions, nations and customers are a tree, events a usage log.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arbolex.functions import scalars, stats
from arbolex.operators import asof, hierarchy, logs, overlay, resolve, text, vector
from arbolex.session import table
from arbolex.sources import ingest
from arbolex.streaming import usage

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Registers a query under its function's name."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# Prefixes and pages


@query("SELECT p_partkey, p_name FROM part WHERE lower(p_name) LIKE 'red%' ORDER BY p_name, p_partkey LIMIT 25 OFFSET 25")
def prefix_page(spark, d):
    rows = table(spark, d, "part").where(scalars.has_prefix("p_name", "RED")).select("p_partkey", "p_name")
    return rows.orderBy("p_name", "p_partkey").offset(25).limit(25)


@query("SELECT count(*) AS total FROM part WHERE lower(p_name) LIKE 'blue%'")
def prefix_total(spark, d):
    return table(spark, d, "part").where(scalars.has_prefix(F.lower("p_name"), "Blue")).agg(F.count(F.lit(1)).alias("total"))


@query("""SELECT p_partkey, p_name FROM part WHERE lower(p_name) LIKE 's%' AND p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_suppkey = 7)
ORDER BY p_name, p_partkey LIMIT 50""")
def prefix_collection(spark, d):
    rows = table(spark, d, "part").where(scalars.has_prefix(F.lower("p_name"), "s")).select(F.col("p_partkey").alias("notation"), "p_name")
    return overlay.present(rows, _counts(spark, d), "7").select(F.col("notation").alias("p_partkey"), "p_name").orderBy("p_name", "p_partkey").limit(50)


def _counts(spark, d) -> DataFrame:
    """lineitem as an overlay: how often a supplier has a part."""
    return table(spark, d, "lineitem").groupBy(F.col("l_suppkey").cast("string").alias("collection_id"), F.col("l_partkey").alias("notation")).agg(F.count(F.lit(1)).alias("count"))


# Overlays


@query("""SELECT p_partkey AS notation, coalesce(n, 0) AS coverage FROM part LEFT JOIN (SELECT l_partkey, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY 1)
ON l_partkey = p_partkey""")
def presence_coverage(spark, d):
    return overlay.coverage(table(spark, d, "part").select(F.col("p_partkey").alias("notation")), _counts(spark, d))


@query("SELECT p_partkey AS notation, p_brand FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_suppkey = 3)")
def presence_filter(spark, d):
    return overlay.present(table(spark, d, "part").select(F.col("p_partkey").alias("notation"), "p_brand"), _counts(spark, d), "3")


@query("""SELECT CAST(s_suppkey AS VARCHAR) AS collection_id, s_name AS label, count(DISTINCT p_partkey) AS known_notations
FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey LEFT JOIN part ON p_partkey = l_partkey AND p_size <= 25 GROUP BY ALL""")
def collection_info(spark, d):
    info = table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("collection_id"), F.col("s_name").alias("label"))
    return overlay.collection_totals(info, _counts(spark, d), table(spark, d, "part").where("p_size <= 25").select(F.col("p_partkey").alias("notation")))


_ASKED = (5, 0, 77, 999999999, 5)


@query(f"""WITH asked AS (SELECT unnest(range({len(_ASKED)})) AS pos, CAST(unnest({list(_ASKED)}) AS BIGINT) AS notation),
held AS (SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT pos, notation, coalesce(p_name, CAST(notation AS VARCHAR)) AS text, CAST(l_suppkey AS VARCHAR) AS collection_id, s_name AS label, coalesce(n, 0) AS count,
row_number() OVER (PARTITION BY pos ORDER BY n DESC, CAST(l_suppkey AS VARCHAR)) - 1 AS place,
'https://example.org/?uri=' || notation AS aggregator_url
FROM asked LEFT JOIN part ON p_partkey = notation LEFT JOIN held ON l_partkey = notation LEFT JOIN supplier ON s_suppkey = l_suppkey""")
def find_artworks(spark, d):
    codes = spark.createDataFrame([(i, str(n)) for i, n in enumerate(_ASKED)], "pos long, notation string")
    labels = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("notation"), F.col("p_name").alias("text"))
    counts = _counts(spark, d).where(F.col("notation").isin(*_ASKED)).withColumn("notation", F.col("notation").cast("string"))  # a page of codes
    info = table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("collection_id"), F.col("s_name").alias("label"), F.lit(None).cast("string").alias("search_url_template"))
    got = overlay.holdings(codes, labels, counts, info, "https://example.org/?uri={code}")
    return got.select("pos", F.col("notation").cast("long").alias("notation"), "text", F.posexplode_outer("collections").alias("place", "c"), "aggregator_url").select(
        "pos", "notation", "text", "c.collection_id", "c.label", F.coalesce("c.count", F.lit(0)).alias("count"), F.coalesce("place", F.lit(0)).cast("long").alias("place"), "aggregator_url"
    )


@query(f"""WITH asked AS (SELECT unnest(range({len(_ASKED)})) AS pos, CAST(unnest({list(_ASKED)}) AS BIGINT) AS notation)
SELECT pos, notation, p_name AS text, p_brand FROM asked JOIN part ON p_partkey = notation ORDER BY pos""")
def resolve_batch(spark, d):
    codes = spark.createDataFrame(list(enumerate(_ASKED)), "pos long, notation long")
    part = table(spark, d, "part").select(F.col("p_partkey").alias("notation"), F.col("p_name").alias("text"), "p_brand")
    return resolve.in_order(codes, part)


def _texts(spark, d) -> DataFrame:
    return table(spark, d, "documents").select(F.col("source").alias("notation"), "lang", "text", F.col("doc_id").alias("ord"))


@query("""SELECT notation, text FROM (SELECT source AS notation, text, row_number() OVER (PARTITION BY source
ORDER BY CASE lang WHEN 'de' THEN 1 WHEN 'en' THEN 2 WHEN 'nl' THEN 3 ELSE 4 END, lang, doc_id) AS k FROM documents) WHERE k = 1""")
def label_fallback(spark, d):
    return resolve.labels(_texts(spark, d), "de")


@query("""SELECT notation, pos, keyword FROM (SELECT notation, keyword, row_number() OVER (PARTITION BY notation ORDER BY lang, doc_id) - 1 AS pos FROM (
SELECT *, min(r) OVER (PARTITION BY notation) AS best FROM (SELECT source AS notation, text AS keyword, lang, doc_id,
CASE lang WHEN 'es' THEN 1 WHEN 'en' THEN 2 WHEN 'nl' THEN 3 ELSE 4 END AS r FROM documents)) WHERE r = best) WHERE pos < 40""")
def keyword_cap(spark, d):
    got = resolve.keywords(_texts(spark, d).withColumnRenamed("text", "keyword"), "es")
    return got.select("notation", F.posexplode("keywords").alias("pos", "keyword")).withColumn("pos", F.col("pos").cast("long"))


@query("""SELECT p_brand, count(DISTINCT l_orderkey) AS count FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_type = 'PROMO' AND p_brand != ''
GROUP BY 1 ORDER BY 2 DESC, 1""")
def count_distinct_export(spark, d):
    mappings = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("object_number"), F.col("l_partkey").alias("vocab_id"), F.lit("subject").alias("field"))
    vocabulary = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_type") == "PROMO", "classification").alias("type"), F.col("p_brand").alias("notation"))
    return overlay.counts_per_code(mappings, vocabulary).withColumnRenamed("notation", "p_brand")


@query("""SELECT count(DISTINCT l_partkey) AS covered, round(100.0 * count(DISTINCT l_partkey) / (SELECT count(*) FROM part), 2) AS percent FROM lineitem WHERE l_quantity > 40""")
def coverage_share(spark, d):
    return stats.covered_share(table(spark, d, "lineitem").where("l_quantity > 40"), "l_partkey", table(spark, d, "part"))


@query("""SELECT p_partkey, count(l_orderkey) AS n FROM part LEFT JOIN lineitem ON l_partkey = p_partkey AND l_returnflag = 'A' GROUP BY 1 ORDER BY n DESC, p_partkey LIMIT 25""")
def left_join_top(spark, d):
    sold = table(spark, d, "lineitem").where("l_returnflag = 'A'").select(F.col("l_partkey").alias("p_partkey"))
    return stats.most_counted(table(spark, d, "part"), sold, "p_partkey", 25)


# Full text

_SQL_TOKENS = "regexp_extract_all(strip_accents(lower(text)), '[\\p{L}\\p{N}]+')"


def _sql_count(phrase: list[str]) -> str:
    m = len(phrase)
    same = " AND ".join(f"t[i + {k}] = '{w}'" for k, w in enumerate(phrase))
    return f"len(list_filter(range(1, len(t) - {m} + 2), lambda i: {same}))"


def _sql_bm25(source: str, key: str, phrases: list[list[str]], scope: str = "true") -> str:
    """BM25 over all rows of a table with columns key and text, in plain SQL."""
    tf = ", ".join(f"{_sql_count(p)} AS tf{i}" for i, p in enumerate(phrases))
    n = range(len(phrases))
    score = " + ".join(
        f"greatest(ln((n - df{i} + 0.5) / (df{i} + 0.5)), 1e-6) * (tf{i} * 2.2 / (tf{i} + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl)))" for i in n
    )
    return f"""SELECT {key}, -({score}) AS rank FROM (SELECT *, len(t) AS dl, {tf} FROM (SELECT *, {_SQL_TOKENS} AS t FROM {source})) ,
(SELECT count(*) AS n, avg(len(t)) AS avgdl, {", ".join(f"count(*) FILTER (tf{i} > 0) AS df{i}" for i in n)} FROM (SELECT *, {tf} FROM (SELECT *, {_SQL_TOKENS} AS t FROM {source})))
WHERE {" AND ".join(f"tf{i} > 0" for i in n)} AND {scope}"""


_indexes: dict[tuple, DataFrame] = {}


def _index(spark, d, name: str, key: str) -> DataFrame:
    """The token index of a table. A store has it as a table of its own, made at ingest; here the first query makes it
    and the session keeps it, spilled to disk where memory is short."""
    at = (spark.sparkContext.applicationId, d, name)
    if at not in _indexes or not _indexes[at].is_cached:
        rows = table(spark, d, name).select(key, "text", *(["source"] if name == "documents" else []))
        rows = rows.repartition(spark.sparkContext.defaultParallelism)  # the driver's tables are one row group each
        _indexes[at] = text.token_table(rows, "text", *(c for c in rows.columns if c != "text")).persist(StorageLevel.MEMORY_AND_DISK)
    return _indexes[at]


@query(f"SELECT doc_id, round(rank, 6) AS rank FROM ({_sql_bm25('documents', 'doc_id', [['of', 'the']])})")
def fts_phrase(spark, d):
    return text.search(_index(spark, d, "documents", "doc_id"), text.phrase_tokens("of (the)")).select("doc_id", F.round("rank", 6).alias("rank"))


@query(f"SELECT doc_id, round(rank, 6) AS rank FROM ({_sql_bm25('documents', 'doc_id', [['that'], ['from']])})")
def fts_and(spark, d):
    return text.search(_index(spark, d, "documents", "doc_id"), text.term_tokens("That/from")).select("doc_id", F.round("rank", 6).alias("rank"))


@query(f"SELECT doc_id, round(rank, 6) AS rank FROM ({_sql_bm25('documents', 'doc_id', [['that'], ['from']], scope="source LIKE 'src1%'")})")
def fts_scoped(spark, d):
    hits = text.search(_index(spark, d, "documents", "doc_id"), text.term_tokens("that from"), scalars.has_prefix("source", "src1"))
    return hits.select("doc_id", F.round("rank", 6).alias("rank"))


@query(f"SELECT doc_id, round(rank, 6) AS rank FROM ({_sql_bm25('documents', 'doc_id', [['by'], ['the'], ['from'], ['of'], ['that']])})")
def fts_fallback(spark, d):
    return text.search_with_fallback([_index(spark, d, "documents", "doc_id")], "by the from of that", "doc_id").select("doc_id", F.round("rank", 6).alias("rank"))


@query(f"""SELECT id, round(min(rank), 6) AS rank FROM (
SELECT 'k' || (doc_id % 97) AS id, rank FROM ({_sql_bm25('documents', 'doc_id', [['the']])})
UNION ALL SELECT 'k' || (item_id % 97) AS id, rank FROM ({_sql_bm25('benchmark', 'item_id', [['the']])})) GROUP BY 1""")
def fts_union_min(spark, d):
    labels = _index(spark, d, "documents", "doc_id").select(F.concat(F.lit("k"), F.col("doc_id") % 97).alias("id"), "padded", "n_tokens")
    words = _index(spark, d, "benchmark", "item_id").select(F.concat(F.lit("k"), F.col("item_id") % 97).alias("id"), "padded", "n_tokens")
    hits = text.best_ranks([text.search(i, text.phrase_tokens("the")) for i in (labels, words)], "id")
    return hits.select("id", F.round("rank", 6).alias("rank"))


@query(f"""SELECT doc_id, len({_SQL_TOKENS}) AS n_tokens FROM documents""")
def token_counts(spark, d):
    return _index(spark, d, "documents", "doc_id").select("doc_id", F.col("n_tokens").cast("long").alias("n_tokens"))


# Vectors

_Q = "list_transform(embedding, lambda x: CAST(trunc(greatest(-127.0, least(127.0, CAST(x AS DOUBLE) * 127))) AS INTEGER))"
_SQL_KNN = """WITH q AS (SELECT vec_id, label, {q} AS e FROM embeddings), v AS (SELECT e AS qe FROM q WHERE vec_id = 0)
SELECT vec_id, floor((1 - dist) * 1000 + 0.5) / 1000 AS similarity FROM (SELECT vec_id, label,
1 - list_sum(list_transform(range(1, len(e) + 1), lambda i: e[i] * qe[i])) / sqrt(CAST(list_sum(list_transform(e, lambda x: x * x)) AS DOUBLE) * list_sum(list_transform(qe, lambda x: x * x))) AS dist
FROM q, v WHERE {where}) ORDER BY dist, vec_id LIMIT 20"""


def _vectors(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", "label", vector.quantized(F.col("embedding")).alias("embedding"))


def _nearest(spark, d, **how) -> DataFrame:
    rows = _vectors(spark, d)
    probe = rows.where("vec_id = 0").select("embedding").first()["embedding"]  # the query vector
    return vector.nearest(rows, "vec_id", list(probe), 20, **how).select("vec_id", vector.similarity(F.col("distance")).alias("similarity"))


@query(_SQL_KNN.format(q=_Q, where="true"))
def knn_global(spark, d):
    return _nearest(spark, d)


@query(_SQL_KNN.format(q=_Q, where="vec_id IN (SELECT doc_id FROM labels WHERE quality = 1)"))
def knn_filtered(spark, d):
    return _nearest(spark, d, keep=table(spark, d, "labels").where("quality = 1").select(F.col("doc_id").alias("vec_id")))


@query(_SQL_KNN.format(q=_Q, where="CAST(vec_id AS VARCHAR) LIKE '1%'"))
def knn_prefix(spark, d):
    return _nearest(spark, d, scope=F.col("vec_id").cast("string").startswith("1"))


@query(f"SELECT vec_id, unnest(range(64)) AS pos, CAST(unnest({_Q}) AS INTEGER) AS value FROM embeddings")
def quantize(spark, d):
    got = _vectors(spark, d).select("vec_id", F.posexplode("embedding").alias("pos", "value"))
    return got.select("vec_id", F.col("pos").cast("long").alias("pos"), F.col("value").cast("int").alias("value"))


@query("""SELECT vec_id, unnest(range(16)) AS pos, round(unnest(list_transform(e, lambda x: x / n)), 6) AS value FROM (SELECT vec_id, e,
greatest(sqrt(list_sum(list_transform(e, lambda x: x * x))), 1e-10) AS n FROM (SELECT vec_id, list_transform(embedding[1:16], lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings))""")
def mrl_truncate(spark, d):
    got = table(spark, d, "embeddings").select("vec_id", F.posexplode(vector.truncated(F.col("embedding"), 16)).alias("pos", "value"))
    return got.select("vec_id", F.col("pos").cast("long").alias("pos"), F.round("value", 6).alias("value"))


# Trees


def _tree(spark, d) -> DataFrame:
    """Regions, nations and customers as nodes: notation, path, children."""
    region = table(spark, d, "region").select(F.concat(F.lit("R"), F.col("r_regionkey")).alias("r"), "r_regionkey")
    nation = table(spark, d, "nation").select(F.concat(F.lit("N"), F.col("n_nationkey")).alias("n"), "n_nationkey", "n_regionkey")
    customer = table(spark, d, "customer").select(F.concat(F.lit("C"), F.col("c_custkey")).alias("c"), "c_nationkey")
    of_region = nation.groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n")).alias("children"))
    of_nation = customer.groupBy("c_nationkey").agg(F.array_sort(F.collect_list("c")).alias("children"))
    none = F.array().cast("array<string>")
    up = nation.select("n", "n_nationkey", F.concat(F.lit("R"), F.col("n_regionkey")).alias("r"))
    return (
        region.join(of_region, region["r_regionkey"] == of_region["n_regionkey"], "left")
        .select(F.col("r").alias("notation"), none.alias("path"), F.coalesce("children", none).alias("children"))
        .unionByName(up.join(of_nation, up["n_nationkey"] == of_nation["c_nationkey"], "left").select(F.col("n").alias("notation"), F.array("r").alias("path"), F.coalesce("children", none).alias("children")))
        .unionByName(customer.join(up, customer["c_nationkey"] == up["n_nationkey"]).select(F.col("c").alias("notation"), F.array("r", "n").alias("path"), none.alias("children")))
    )


@query("""WITH n AS (SELECT 'N' || n_nationkey AS n, n_nationkey, row_number() OVER (ORDER BY 'N' || n_nationkey) - 1 AS i FROM nation WHERE n_regionkey = 1),
c AS (SELECT 'C' || c_custkey AS c, n.i, count(*) OVER (PARTITION BY n.n) AS kids, row_number() OVER (PARTITION BY n.n ORDER BY 'C' || c_custkey) - 1 AS j FROM customer JOIN n ON c_nationkey = n_nationkey)
SELECT row_number() OVER (ORDER BY i, j) - 1 AS pos, notation, depth, total_children, truncated FROM (SELECT * FROM (
SELECT i, -1 AS j, n AS notation, 1 AS depth, (SELECT count(*) FROM customer WHERE c_nationkey = n.n_nationkey) AS total_children, (SELECT count(*) FROM customer WHERE c_nationkey = n.n_nationkey) > 25 AS truncated FROM n WHERE i < 25
UNION ALL SELECT i, j, c, 2, 0, false FROM c WHERE i < 25 AND j < 25) ORDER BY i, j LIMIT 250)""")
def subtree_dfs(spark, d):
    tree = _tree(spark, d)
    got = hierarchy.subtree(tree, tree.where("notation = 'R1'"), depth=2)
    pos = F.row_number().over(Window.orderBy("ord")) - 1  # at most 250 rows
    return got.select(pos.cast("long").alias("pos"), "notation", "depth", F.col("total_children").cast("long").alias("total_children"), "truncated")


@query("""SELECT 'N' || n_nationkey AS notation, 0 AS pos, 'R' || n_regionkey AS ancestor FROM nation
UNION ALL SELECT 'C' || c_custkey, 0, 'R' || n_regionkey FROM customer JOIN nation ON n_nationkey = c_nationkey UNION ALL SELECT 'C' || c_custkey, 1, 'N' || c_nationkey FROM customer""")
def ancestors(spark, d):
    return hierarchy.ancestors(_tree(spark, d))


@query("""SELECT code, max_by(p, length(p)) AS ancestor FROM (SELECT DISTINCT p_brand AS code FROM part) LEFT JOIN (SELECT DISTINCT p_brand AS p FROM part)
ON starts_with(code, p) AND p != code GROUP BY 1""")
def longest_prefix(spark, d):
    brands = table(spark, d, "part").select(F.col("p_brand").alias("code"))
    return hierarchy.longest_prefix(brands, brands.withColumnRenamed("code", "notation"))


@query("""SELECT a.b AS code, c.b AS candidate FROM (SELECT DISTINCT p_brand AS b FROM part) a, (SELECT DISTINCT p_brand AS b FROM part) c WHERE levenshtein(a.b, c.b) = 1""")
def near_codes(spark, d):
    brands = table(spark, d, "part").select(F.col("p_brand").alias("code")).distinct()
    return hierarchy.near_known(brands, hierarchy.edit_index(brands, "code")).select("code", "candidate")


@query("""SELECT CAST(l_partkey AS BIGINT) AS ref, p_name, row_number() OVER (ORDER BY p_name IS NULL, l_partkey) AS place
FROM (SELECT DISTINCT l_partkey FROM lineitem WHERE l_suppkey = 5) LEFT JOIN part ON p_partkey = l_partkey AND p_size > 20""")
def cross_references(spark, d):
    refs = table(spark, d, "lineitem").where("l_suppkey = 5").select(F.col("l_partkey").alias("ref")).distinct()
    part = table(spark, d, "part").where("p_size > 20").select(F.col("p_partkey").alias("ref"), "p_name")
    got = resolve.cross_references(refs, part, "ref")  # the references of one code: a page
    return got.withColumn("place", F.row_number().over(Window.orderBy("_known", "ref")).cast("long")).drop("_known")


# Log analytics


def _events(spark, d) -> DataFrame:
    return table(spark, d, "events").withColumnRenamed("event_id", "ord")


_SQL_SESSIONS = """SELECT *, sum(CASE WHEN before IS NULL OR ts - before > INTERVAL 10 MINUTE THEN 1 ELSE 0 END) OVER (ORDER BY ts, event_id) AS session
FROM (SELECT *, lag(ts) OVER (ORDER BY ts, event_id) AS before FROM events)"""


@query(f"""SELECT CAST(session AS BIGINT) AS session, min(ts) AS start, max(ts) AS "end", count(*) AS calls FROM ({_SQL_SESSIONS}) GROUP BY 1""")
def sessions_by_gap(spark, d):
    got = logs.with_sessions(_events(spark, d), gap=600)
    return got.groupBy("session").agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count(F.lit(1)).alias("calls"))


@query(f"""SELECT CAST(session AS BIGINT) AS session, CASE WHEN count(*) FILTER (event_type = 'error') > 3 THEN 'concept-search'
WHEN count(*) FILTER (event_type IN ('view', 'signup')) > 5 THEN 'hierarchy-exploration' WHEN count(*) FILTER (event_type = 'purchase') > 3 THEN 'collection-discovery'
WHEN count(*) FILTER (event_type = 'click') > 5 AND count(DISTINCT event_type) <= 2 THEN 'batch-resolution'
WHEN count(*) <= 3 AND max(ts) - min(ts) < INTERVAL 2 MINUTE THEN 'quick-lookup' ELSE 'browsing' END AS class FROM ({_SQL_SESSIONS}) GROUP BY 1""")
def session_class(spark, d):
    n = lambda t: F.count_if(F.col("event_type") == t)
    got = logs.with_sessions(_events(spark, d), gap=600).groupBy("session").agg(
        logs.session_class(n("error"), n("view"), n("signup"), n("purchase"), n("click"), F.count_distinct("event_type"), F.count(F.lit(1)), (scalars.micros(F.max("ts")) - scalars.micros(F.min("ts"))) / 1e6).alias("class")
    )
    return got


@query("""SELECT user_id, event_type, a AS first, b AS repeat, round(a / greatest(b, 1), 6) AS speedup FROM (SELECT user_id, event_type, max(CASE WHEN k = 1 THEN value END) AS a,
max(CASE WHEN k = 2 THEN value END) AS b FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events) GROUP BY ALL)
WHERE a > 20 AND a / greatest(b, 1) > 2 ORDER BY a / greatest(b, 1) DESC, user_id, event_type LIMIT 10""")
def repeat_speedup(spark, d):
    return logs.repeats(_events(spark, d), ["user_id", "event_type"], "value", ["ts", "ord"]).withColumn("speedup", F.round("speedup", 6))


@query("""SELECT event_id, user_id, ts, (SELECT min(b.ts) FROM events b WHERE b.user_id = a.user_id AND b.event_type = 'purchase' AND b.ts > a.ts) AS next_ts
FROM events a WHERE event_type = 'signup'""")
def asof_forward(spark, d):
    rows = table(spark, d, "events")
    return asof.next_after(rows.where("event_type = 'signup'").select("user_id", "ts", "event_id"), rows.where("event_type = 'purchase'").select("user_id", "ts"), ["user_id"]).select("event_id", "user_id", "ts", "next_ts")


def _at(p: int, list_: str = "l") -> str:
    return f"{list_}[least(CAST(floor(len({list_}) * {p} / 100) AS BIGINT), len({list_}) - 1) + 1]"


@query(f"""SELECT event_type, len(l) AS n, l[1] AS min, {", ".join(f"{_at(p)} AS p{p}" for p in (25, 50, 75, 90, 95, 99))}, l[len(l)] AS max, round(m, 2) AS mean
FROM (SELECT event_type, list_sort(list(value)) AS l, avg(value) AS m FROM events GROUP BY 1)""")
def latency_percentiles(spark, d):
    return stats.describe(table(spark, d, "events"), "value", ["event_type"])


@query(f"""SELECT event_type AS tool, len(l) AS calls, e AS errors, l[1] AS min, {_at(50)} AS p50, l[len(l)] AS max, round(100.0 * e / len(l), 1) AS error_percent
FROM (SELECT event_type, list_sort(list(value)) AS l, count(*) FILTER (value > 200) AS e FROM events GROUP BY 1)""")
def traffic_summary(spark, d):
    return logs.traffic(_calls(spark, d))


def _calls(spark, d) -> DataFrame:
    return _events(spark, d).select("ord", "ts", F.col("event_type").alias("tool"), F.col("value").alias("ms"), (F.col("value") <= 200).alias("ok"), F.col("props").alias("input"))


@query("""SELECT event_id AS ord, ts, event_type AS tool, CAST(trunc(value) AS BIGINT) AS ms, value <= 200 AS ok, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events""")
def log_lines(spark, d):
    rows = table(spark, d, "events")
    line = F.to_json(F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"), F.concat(F.lit("Server:"), F.col("event_type")).alias("tool"), F.col("value").alias("ms"), (F.col("value") <= 200).alias("ok"), F.col("props").alias("input")))
    junk = rows.where("event_id % 7 = 0").select((F.col("event_id") + 10**9).alias("ord"), F.lit('{"broken').alias("value"))
    got = logs.calls(rows.select(F.col("event_id").alias("ord"), line.alias("value")).unionByName(junk))
    return got.select("ord", "ts", "tool", "ms", "ok", F.get_json_object("input", "$.k").cast("long").alias("k"))


@query("""SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-07 23:59:59.999999'""")
def date_range(spark, d):
    return logs.between(table(spark, d, "events"), "2024-01-05", "2024-01-07").select("event_id", "ts")


@query("""SELECT user_id, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 / (count(*) - 1), 3) AS seconds FROM events GROUP BY 1 HAVING count(*) > 1""")
def mean_interval(spark, d):
    return logs.mean_interval(table(spark, d, "events"), ["user_id"])


@query("""SELECT event_type AS key, count(*) AS n FROM events WHERE value > 100 GROUP BY 1 ORDER BY n DESC, min(event_id) LIMIT 3""")
def top_k_counter(spark, d):
    return stats.top_counts(table(spark, d, "events").where("value > 100"), "event_type", "event_id", 3)


@query("""SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS calls, count(*) FILTER (value > 200) AS errors FROM events GROUP BY 1""")
def daily_usage(spark, d):
    return usage.by_day(_calls(spark, d)).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


_TOOL_USAGE = """SELECT event_type AS tool, count(*) AS calls, count(*) FILTER (value > 200) AS errors, round(sum(value), 4) AS total_ms, max(value) AS max_ms FROM events GROUP BY 1"""


@query(_TOOL_USAGE)
def tool_usage(spark, d):
    return usage.by_tool(_calls(spark, d)).withColumn("total_ms", F.round("total_ms", 4))


@query(_TOOL_USAGE)
def stream_tool_usage(spark, d):
    """The same counters, kept by a stream that reads all there is and stops."""
    rows = spark.readStream.schema(table(spark, d, "events").schema).option("pathGlobFilter", "events*.parquet").parquet(d)
    calls = rows.select(F.col("event_type").alias("tool"), F.col("value").alias("ms"), (F.col("value") <= 200).alias("ok"))
    name = f"usage_{uuid.uuid4().hex}"
    run = usage.by_tool(calls).writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.table(name).withColumn("total_ms", F.round("total_ms", 4))


@query(f"""SELECT n, min, median, max, single_percent FROM (SELECT len(l) AS n, l[1] AS min, {_at(50)} AS median, l[len(l)] AS max, CAST(floor(100.0 * len(list_filter(l, lambda x: x = 1)) / len(l)) AS BIGINT) AS single_percent
FROM (SELECT list_sort(list(c)) AS l FROM (SELECT CAST(count(*) AS INTEGER) AS c FROM conversations GROUP BY conv_id)))""")
def batch_sizes(spark, d):
    sized = table(spark, d, "conversations").groupBy("conv_id").agg(F.to_json(F.struct(F.collect_list(F.col("turn").cast("string")).alias("notation"))).alias("input"))
    return logs.batch_sizes(sized.select("input", F.lit("resolve").alias("tool")), "resolve")


@query("""SELECT 'unknown' AS tool UNION ALL SELECT 'logout'""")
def anti_unused(spark, d):
    return logs.unused_tools(_calls(spark, d), ("click", "unknown", "view", "logout", "error"))


@query("""SELECT count(*) AS n, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS total, count(DISTINCT CAST(json_extract(props, '$.k') AS BIGINT)) AS kinds FROM events""")
def json_props(spark, d):
    k = F.from_json("props", "k long")["k"]
    return table(spark, d, "events").agg(F.count(F.lit(1)).alias("n"), F.sum(k).alias("total"), F.count_distinct(k).alias("kinds"))


# Distributions


@query("""WITH c AS (SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1)
SELECT bucket, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM c), 1) AS percent FROM (SELECT CASE WHEN n <= 0 THEN '0' WHEN n <= 5 THEN '1-5' WHEN n <= 10 THEN '6-10' WHEN n <= 15 THEN '11-15' ELSE '16+' END AS bucket FROM c) GROUP BY 1""")
def buckets(spark, d):
    got = _orders_by_customer(spark, d)
    counts = got.groupBy(stats.bucket(F.col("n"), (0, 5, 10, 15)).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("percent", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy()), 1))  # one row a bucket


def _orders_by_customer(spark, d) -> DataFrame:
    customer = table(spark, d, "customer").select("c_custkey")
    counts = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    return customer.join(counts, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"))


@query("""SELECT round(avg(CASE WHEN n <= 10 THEN 1 ELSE 0 END), 4) AS share FROM (SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1)""")
def cap_share(spark, d):
    return stats.share_within(_orders_by_customer(spark, d), "n", 10)


@query("""SELECT size, prefix, n FROM (SELECT *, row_number() OVER (PARTITION BY size ORDER BY n DESC, prefix) AS k FROM (SELECT size, substring(p_name, 1, size) AS prefix, count(*) AS n
FROM part, (SELECT unnest([1, 2, 3]) AS size) GROUP BY 1, 2)) WHERE k <= 5""")
def prefix_hist(spark, d):
    return stats.largest_prefixes(stats.prefix_counts(table(spark, d, "part"), "p_name"), 5)


# Sets, upserts, scalars


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def set_union(spark, d):
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("k")).union(table(spark, d, "supplier").select("s_nationkey")).distinct()


@query("SELECT c_custkey AS k FROM customer INTERSECT SELECT o_custkey FROM orders WHERE o_totalprice > 300000")
def set_intersect(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("k")).intersect(table(spark, d, "orders").where("o_totalprice > 300000").select("o_custkey"))


@query("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def set_except(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("k")).subtract(table(spark, d, "orders").where("o_orderstatus = 'F'").select("o_custkey"))


@query("""SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events) WHERE k = 1""")
def keep_latest_upsert(spark, d):
    return ingest.latest(table(spark, d, "events").select("user_id", "event_id", "event_type", "value"), ["user_id"], "event_id")


@query("""SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_suppkey = 1 INTERSECT SELECT l_partkey FROM lineitem WHERE l_quantity > 10)""")
def resume_todo(spark, d):
    from arbolex.sources.store import resume

    item = table(spark, d, "lineitem")
    one, two = (item.where(c).select(F.col("l_partkey").alias("p_partkey")) for c in ("l_suppkey = 1", "l_quantity > 10"))
    return resume(table(spark, d, "part").select("p_partkey"), one, two, key="p_partkey")


@query("""SELECT p_partkey, '[Description] ' || p_name || ' [Keywords] ' || p_type || ', ' || p_brand || CASE WHEN p_size > 25 THEN ' [Category] ' || p_type || ' > ' || p_brand ELSE '' END AS text FROM part""")
def composite_text(spark, d):
    category = F.when(F.col("p_size") > 25, F.concat(F.lit("[Category] "), F.concat_ws(" > ", "p_type", "p_brand")))
    return table(spark, d, "part").select("p_partkey", F.concat_ws(" ", F.concat(F.lit("[Description] "), "p_name"), F.concat(F.lit("[Keywords] "), F.concat_ws(", ", "p_type", "p_brand")), category).alias("text"))


@query("""SELECT p_partkey, replace(replace(p_name, ' ', '%20'), '#', '%23') || '%26(x!)%2B~' || replace(p_brand, '#', '%23') AS url FROM part""")
def url_encode(spark, d):
    return table(spark, d, "part").select("p_partkey", scalars.encode_uri_component(F.concat("p_name", F.lit("&(x!)+~"), "p_brand")).alias("url"))


@query("""SELECT p_partkey, 'https://example.org/?uri=' || replace(p_brand, '#', '%2523') || '%2528%252B' || p_size || '%2529' AS url FROM part""")
def nested_url(spark, d):
    code = F.concat("p_brand", F.lit("(+"), "p_size", F.lit(")"))
    return table(spark, d, "part").select("p_partkey", scalars.nested_url(code, "https://example.org/?uri={code}").alias("url"))


@query("""SELECT page_id, 'https://example.org/find?q=' || replace(replace(replace(replace(replace(url_encode(url), '%21', '!'), '%2A', '*'), '%27', chr(39)), '%28', '('), '%29', ')') AS link FROM pages""")
def templated_url(spark, d):
    return table(spark, d, "pages").select("page_id", scalars.templated_url(F.lit("https://example.org/find?q={notation}"), F.col("url")).alias("link"))


@query("""SELECT p_partkey, code, code LIKE '%(%' AND code LIKE '%+%' AS keyed, split_part(code, '(', 1) AS base, '+' || p_size AS key_id, p_name || ' (+ ' || p_type || ')' AS label
FROM (SELECT *, p_brand || CASE WHEN p_size > 25 THEN '(+' || p_size || ')' ELSE '' END AS code FROM part)""")
def code_parts(spark, d):
    code = F.concat("p_brand", F.when(F.col("p_size") > 25, F.concat(F.lit("(+"), "p_size", F.lit(")"))).otherwise(F.lit("")))
    rows = table(spark, d, "part").withColumn("code", code)
    return rows.select("p_partkey", "code", scalars.is_modified(F.col("code")).alias("keyed"), scalars.without_modifier(F.col("code")).alias("base"), scalars.modifier_id(F.concat(F.lit("11k"), "p_size")).alias("key_id"), scalars.composed_label(F.col("p_name"), F.col("p_type")).alias("label"))


@query("""SELECT user_id, CAST(floor(s / 3600) AS BIGINT) || 'h ' || CAST(floor(s % 3600 / 60) AS BIGINT) || 'm' AS span FROM (SELECT user_id, floor((epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000) AS s FROM events GROUP BY 1) WHERE s >= 3600
UNION ALL SELECT user_id, CAST(floor(s / 60) AS BIGINT) || 'm ' || CAST(s % 60 AS BIGINT) || 's' FROM (SELECT user_id, floor((epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000) AS s FROM events GROUP BY 1) WHERE s < 3600""")
def durations(spark, d):
    spans = table(spark, d, "events").groupBy("user_id").agg(((scalars.micros(F.max("ts")) - scalars.micros(F.min("ts"))) / 1000000).alias("s"))
    return spans.select("user_id", scalars.duration_text(F.col("s")).alias("span"))


@query("""SELECT conv_id, CASE WHEN len(l) > 5 THEN array_to_string(l[1:5], ',') || ',+' || (len(l) - 5) || ' more' ELSE array_to_string(l, ',') END AS shown
FROM (SELECT conv_id, list(CAST(turn AS VARCHAR) ORDER BY turn) AS l FROM conversations GROUP BY 1)""")
def cut_list(spark, d):
    turns = table(spark, d, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list("turn")), lambda x: x.cast("string")).alias("l"))
    return turns.select("conv_id", F.array_join(scalars.cut_list(F.col("l")), ",").alias("shown"))


@query("""WITH a AS (SELECT p_partkey AS k FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 500), b AS (SELECT l_partkey AS k FROM lineitem GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 500)
SELECT count(*) AS shared FROM a JOIN b USING (k)""")
def ranking_overlap(spark, d):
    a = table(spark, d, "part").orderBy(F.desc("p_retailprice"), "p_partkey").limit(500).select(F.col("p_partkey").alias("k"))
    b = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("k")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "k").limit(500).select("k")
    return a.join(b, "k").agg(F.count(F.lit(1)).alias("shared"))


@query("""SELECT o_orderstatus, count(*) AS n, round(avg(length(o_orderpriority)), 4) AS mean_length, count(*) FILTER (o_totalprice > 200000) AS dear FROM orders GROUP BY 1""")
def conditional_counts(spark, d):
    got = stats.split_counts(table(spark, d, "orders"), F.col("o_totalprice") > 200000, F.col("o_orderpriority"), "o_orderstatus")
    return got.select("o_orderstatus", "n", "mean_length", F.col("flagged").alias("dear"))


def _asked(spark, d) -> DataFrame:
    """Events as calls of the tools, with inputs made of their k."""
    k = F.get_json_object("props", "$.k").cast("long")
    word, text_ = F.concat(F.lit("w"), k.cast("string")), k.cast("string")
    kind = F.col("event_type")
    json = lambda **c: F.to_json(F.struct(*(v.alias(n) for n, v in c.items())))
    search = F.when(k % 2 == 0, json(query=word)).otherwise(json(semanticQuery=word, parentNotation=(k % 5).cast("string")))
    input_ = F.when(kind == "click", search).when(kind == "view", json(notation=text_, depth=k % 3 + 1)).when(kind == "purchase", json(notation=text_, offset=k % 4))
    input_ = input_.when(kind == "signup", json(notation=F.array(text_, F.lit("7")))).otherwise(json(notation=text_))
    tool = F.when(kind == "click", "search").when(kind == "view", "browse").when(kind == "purchase", "search_prefix").when(kind == "signup", "find_artworks").otherwise("resolve")
    return _events(spark, d).select("ord", "ts", tool.alias("tool"), input_.alias("input"))


_BREAKDOWN = """e AS (SELECT event_id, event_type AS t, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events), r AS (
SELECT event_id, 'search' AS tool, 'mode' AS aspect, CASE WHEN k % 2 = 0 THEN 'keyword' ELSE 'semantic' END AS key FROM e WHERE t = 'click'
UNION ALL SELECT event_id, 'search', CASE WHEN k % 2 = 0 THEN 'query' ELSE 'semanticQuery' END, 'w' || k FROM e WHERE t = 'click'
UNION ALL SELECT event_id, 'search', 'parentNotation', CAST(k % 5 AS VARCHAR) FROM e WHERE t = 'click' AND k % 2 = 1
UNION ALL SELECT event_id, CASE t WHEN 'view' THEN 'browse' ELSE 'search_prefix' END, 'notation', CAST(k AS VARCHAR) FROM e WHERE t IN ('view', 'purchase')
UNION ALL SELECT event_id, 'browse', 'depth', CAST(k % 3 + 1 AS VARCHAR) FROM e WHERE t = 'view'
UNION ALL SELECT event_id, 'search_prefix', 'length', CAST(length(CAST(k AS VARCHAR)) AS VARCHAR) FROM e WHERE t = 'purchase'
UNION ALL SELECT event_id, 'search_prefix', 'paged', 'true' FROM e WHERE t = 'purchase' AND k % 4 > 0
UNION ALL SELECT event_id, 'find_artworks', 'batch', '2' FROM e WHERE t = 'signup'
UNION ALL SELECT event_id, 'find_artworks', 'notation', unnest([CAST(k AS VARCHAR), '7']) FROM e WHERE t = 'signup'
UNION ALL SELECT event_id, 'resolve', 'batch', '1' FROM e WHERE t NOT IN ('click', 'view', 'purchase', 'signup')),
b AS (SELECT tool, aspect, key, count(*) AS n, min(event_id) AS first FROM r GROUP BY 1, 2, 3)"""


@query(f"WITH {_BREAKDOWN} SELECT * FROM b")
def tool_breakdown(spark, d):
    return logs.breakdown(_asked(spark, d))


@query(f"WITH {_BREAKDOWN} SELECT tool, aspect, place, key, n FROM (SELECT *, CAST(row_number() OVER (PARTITION BY tool, aspect ORDER BY n DESC, first, key) AS INTEGER) AS place FROM b) WHERE place <= 10")
def tool_favourites(spark, d):
    return logs.top_per_aspect(logs.breakdown(_asked(spark, d)))


@query("""SELECT count(*) AS calls, count(*) FILTER (value > 200) AS errors, round(100.0 * count(*) FILTER (value > 200) / count(*), 2) AS error_percent,
CAST(1 + count(*) FILTER (epoch_us(ts) - epoch_us(before) > 3600000000) AS BIGINT) AS sessions, min(ts) AS first_ts, max(ts) AS last_ts
FROM (SELECT *, lag(ts) OVER (ORDER BY ts, event_id) AS before FROM events)""")
def log_totals(spark, d):
    return logs.totals(_calls(spark, d))


@query("""WITH a AS (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS r FROM part),
b AS (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) AS r FROM part)
SELECT p_brand, count(*) FILTER (a.r <= 5 AND b.r <= 5) AS shared, bool_or(a.r = 1 AND b.r = 1) AS same_first FROM a JOIN b USING (p_brand, p_partkey) GROUP BY 1""")
def model_agreement(spark, d):
    part = table(spark, d, "part")
    ranked = lambda c: part.select("p_brand", "p_partkey", F.col(c).cast("double").alias("score"))
    return vector.agreement(ranked("p_retailprice"), ranked("p_size"), 5, "p_brand", "p_partkey")


@query("""SELECT p_partkey, p_name FROM part ORDER BY md5('3:' || CAST(p_partkey AS VARCHAR)), p_partkey LIMIT 100""")
def random_sample(spark, d):
    return stats.drawn(table(spark, d, "part").select("p_partkey", "p_name"), "p_partkey", 100, 3)
