"""Queries over what ingest prepares (ranked postings, clusters, tree intervals, kept sums), over tables that change, and
over streams with state; each with the SQL that must give the same rows."""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbolex.operators import asof, engine, hierarchy, logs, overlay, ranked, text, vector
from arbolex.plans.registry import _at, _sql_bm25, _tree, _vectors, query
from arbolex.plans.vocabulary import _SQL_CALLS, _SQL_STORE, _log_lines, opened, tables
from arbolex.session import ship, table, work_folder
from arbolex.sources import merging, parts, store
from arbolex.streaming import sessions

# As-of joins


@query("""SELECT a.event_id, a.ts, min(b.ts) AS next_ts FROM (SELECT event_id, ts, (SELECT min(c.ts) FROM events c WHERE c.event_type = 'purchase' AND c.ts > e.ts) AS n FROM events e WHERE event_type != 'purchase') a LEFT JOIN events b ON b.ts = a.n GROUP BY 1, 2""")
def asof_one_key(spark, d):
    """The next purchase of anyone, after each other event: all rows have one key."""
    rows = table(spark, d, "events").withColumn("k", F.lit(0))
    other = rows.where("event_type = 'purchase'").select("k", "ts")
    return asof.next_after(rows.where("event_type != 'purchase'").select("k", "ts", "event_id"), other, ["k"]).select("event_id", "ts", "next_ts")


# Ranked retrieval

_indexed: dict[tuple[str, str], str] = {}


def _documents(spark: SparkSession, d: str) -> ranked.Postings:
    """Postings of the documents' whole texts, written at first use in a session as an ingest would."""
    at = (spark.sparkContext.applicationId, d)
    if at not in _indexed:
        path = work_folder(spark)
        rows = table(spark, d, "documents").select("doc_id", "source", "text")
        text.token_table(rows, "text", "doc_id", "source").write.option("compression", "zstd").parquet(path)
        store.write_postings(spark.read.parquet(path), path)
        _indexed[at] = path
    return store.read_postings(spark, _indexed[at])


@query(f"SELECT doc_id, round(rank, 6) AS rank FROM ({_sql_bm25('documents', 'doc_id', [['that'], ['from']])}) ORDER BY rank, doc_id LIMIT 25")
def ranked_page(spark, d):
    """The best page of a broad query, from the blocks that can hold it."""
    return ranked.page(_documents(spark, d), text.term_tokens("that/from"), 25).rows.select("doc_id", F.round("rank", 6).alias("rank"))


@query(f"SELECT doc_id, round(rank, 6) AS rank FROM ({_sql_bm25('documents', 'doc_id', [['of', 'the']], scope="source LIKE 'src1%'")}) ORDER BY rank, doc_id LIMIT 10")
def ranked_phrase_page(spark, d):
    got = ranked.page(_documents(spark, d), text.phrase_tokens("of (the)"), 10, F.col("source").startswith("src1"))
    return got.rows.select("doc_id", F.round("rank", 6).alias("rank"))


@query(f"SELECT doc_id, round(rank, 6) AS rank FROM ({_sql_bm25('documents', 'doc_id', [['that'], ['from'], ['by']])})")
def ranked_hits(spark, d):
    """All hits of an AND of words, whose postings meet bucket by bucket."""
    return ranked.search_postings(_documents(spark, d), [["that"], ["from"], ["by"]]).select("doc_id", F.round("rank", 6).alias("rank"))


@query(r"""WITH t AS (SELECT doc_id, unnest(string_split(trim(regexp_replace(regexp_replace(lower(strip_accents(coalesce(text, ''))), '[^a-z0-9]+', ' ', 'g'), ' +', ' ', 'g')), ' ')) AS token FROM documents)
SELECT token, count(DISTINCT doc_id) AS df FROM t WHERE token IN ('the', 'that', 'from', 'by', 'of') GROUP BY 1""")
def token_frequencies(spark, d):
    """Document frequencies as the index keeps them."""
    return _documents(spark, d).tokens.where(F.col("token").isin("the", "that", "from", "by", "of")).select("token", "df")


# Vectors

_Q = "list_transform(embedding, lambda x: CAST(trunc(greatest(-127.0, least(127.0, CAST(x AS DOUBLE) * 127))) AS INTEGER))"
_clustered: dict[tuple[str, str], str] = {}


@query(f"""WITH q AS (SELECT vec_id, {_Q} AS e FROM embeddings), far AS (SELECT 'q' || a.vec_id AS query, b.vec_id, 1 - list_sum(list_transform(range(1, 65), lambda i: a.e[i] * b.e[i])) / sqrt(CAST(list_sum(list_transform(a.e, lambda x: x * x)) AS DOUBLE) * list_sum(list_transform(b.e, lambda x: x * x))) AS d
FROM q a, q b WHERE a.vec_id % 20 = 0) SELECT query, vec_id, floor((1 - d) * 1000 + 0.5) / 1000 AS similarity FROM far QUALIFY row_number() OVER (PARTITION BY query ORDER BY d, vec_id) <= 5""")
def knn_many(spark, d):
    """The nearest five of every twentieth vector, all at once, from the clusters that may hold them."""
    at = (spark.sparkContext.applicationId, d)
    if at not in _clustered:
        path, rows = work_folder(spark), _vectors(spark, d)
        centres = vector.centres(rows)
        vector.clustered(rows, centres).repartitionByRange("cluster").sortWithinPartitions("cluster").write.parquet(f"{path}/vectors")
        vector.cluster_table(spark.read.parquet(f"{path}/vectors"), centres).write.parquet(f"{path}/clusters")
        _clustered[at] = path
    rows, clusters = (spark.read.parquet(f"{_clustered[at]}/{n}") for n in ("vectors", "clusters"))
    asked = rows.where("vec_id % 20 = 0").select(F.concat(F.lit("q"), "vec_id").alias("query"), "embedding")
    got = vector.nearest_each(rows, "vec_id", asked, 5, clusters)
    return got.select("query", "vec_id", vector.similarity(F.col("distance")).alias("similarity"))


# Trees

_SQL_TREE = """n AS (SELECT 'R' || r_regionkey AS notation, NULL AS parent, 0 AS depth, ['R' || r_regionkey] AS line FROM region
UNION ALL SELECT 'N' || n_nationkey, 'R' || n_regionkey, 1, ['R' || n_regionkey, 'N' || n_nationkey] FROM nation
UNION ALL SELECT 'C' || c_custkey, 'N' || n_nationkey, 2, ['R' || n_regionkey, 'N' || n_nationkey, 'C' || c_custkey] FROM customer JOIN nation ON c_nationkey = n_nationkey)"""


@query(f"""WITH {_SQL_TREE} SELECT notation, parent, depth, row_number() OVER (ORDER BY line) - 1 AS pre, (SELECT count(*) FROM n b WHERE list_contains(b.line, a.notation)) AS size FROM n a""")
def tree_intervals(spark, d):
    """Each node's place in pre-order and its subtree's size."""
    got = hierarchy.intervals(_tree(spark, d))
    return got.select("notation", "parent", F.col("depth").cast("int").alias("depth"), "pre", "size")


_trees: dict[tuple[str, str], str] = {}


def _stored_tree(spark: SparkSession, d: str) -> DataFrame:
    at = (spark.sparkContext.applicationId, d)
    if at not in _trees:
        _trees[at] = work_folder(spark)
        hierarchy.intervals(_tree(spark, d)).repartitionByRange("pre").sortWithinPartitions("pre").write.parquet(_trees[at])
    return spark.read.parquet(_trees[at])


@query(f"""WITH {_SQL_TREE} SELECT notation, count(*) - 1 AS below FROM (SELECT unnest(line) AS notation FROM n) GROUP BY 1 HAVING count(*) > 1""")
def subtree_totals(spark, d):
    """How many nodes are below each inner one: read, not counted."""
    return _stored_tree(spark, d).where("size > 1").select("notation", (F.col("size") - 1).alias("below"))


@query(f"""WITH {_SQL_TREE} SELECT notation, depth FROM n WHERE list_contains(line, 'N7')""")
def subtree_range(spark, d):
    """A whole subtree as a range of a stored tree."""
    tree = _stored_tree(spark, d)
    root = tree.where("notation = 'N7'").first()
    return hierarchy.below(tree, root["pre"], root["size"]).select("notation", F.col("depth").cast("int").alias("depth"))


@query("""SELECT 'C' || c_custkey || 'x' AS code, CASE WHEN c_custkey % 3 = 0 THEN 'N' || c_nationkey WHEN c_custkey % 3 = 1 THEN 'R' || n_regionkey END AS ancestor FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def deepest_known(spark, d):
    """The deepest known step of paths that lead out of the tree."""
    nation = table(spark, d, "nation").select("n_nationkey", "n_regionkey")
    rows = table(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    up, mid, out = F.concat(F.lit("R"), "n_regionkey"), F.concat(F.lit("N"), "n_nationkey"), F.concat(F.lit("C"), "c_custkey", F.lit("x"))
    path = F.when(F.col("c_custkey") % 3 == 0, F.array(up, mid, out)).when(F.col("c_custkey") % 3 == 1, F.array(up, F.concat(mid, F.lit("?")), out)).otherwise(F.array(F.lit("?"), out))
    return hierarchy.deepest_known(rows.select(out.alias("code"), path.alias("path")), _stored_tree(spark, d))


# Tables that change


@query("""SELECT event_id, CASE WHEN event_id % 11 = 0 THEN value + 2 WHEN event_id % 7 = 0 THEN value + 1 ELSE value END AS value FROM events WHERE event_id % 2 = 0 OR event_id % 7 = 0 OR event_id % 11 = 0""")
def merged_table(spark, d):
    """A table changed twice by key, read with its deltas, and compacted in between."""
    path, rows = work_folder(spark), table(spark, d, "events").select("event_id", "value")
    merging.merge(spark, path, rows.where("event_id % 2 = 0"), ["event_id"])
    merging.merge(spark, path, rows.where("event_id % 7 = 0").withColumn("value", F.col("value") + 1), ["event_id"])
    merging.compact(spark, path, ["event_id"])
    merging.merge(spark, path, rows.where("event_id % 11 = 0").withColumn("value", F.col("value") + 2), ["event_id"])
    return merging.read(spark, path, ["event_id"])


@query(f"""WITH {_SQL_STORE}, more AS (SELECT * FROM counts UNION SELECT 'c9', 'P' || p_partkey, p_size FROM part WHERE p_partkey % 3 = 0), pairs AS (SELECT DISTINCT collection_id, notation FROM more)
SELECT 'code' AS kind, notation AS name, string_agg(collection_id, '|' ORDER BY collection_id) AS collections, count(*) AS n FROM pairs GROUP BY 2
UNION ALL SELECT 'collection', collection_id, NULL, count(*) FROM pairs WHERE notation IN (SELECT notation FROM nodes) GROUP BY 2""")
def kept_sums(spark, d):
    """The sums of an overlay after an upsert that brought a new collection."""
    path, own = work_folder(spark), tables(spark, d)
    store.write(store.vocabulary(spark, **{k: own[k] for k in ("notations", "texts", "counts", "info")}), path)
    new = table(spark, d, "part").where("p_partkey % 3 = 0").select(F.lit("c9").alias("collection_id"), F.concat(F.lit("P"), "p_partkey").alias("notation"), F.col("p_size").cast("int").alias("count"))
    store.upsert_counts(spark, path, new)
    store.upsert_counts(spark, path, new.limit(5))  # again, which changes nothing
    sums = store.open_store(spark, path).sums
    return sums.select("kind", "name", F.array_join("collections", "|").alias("collections"), F.coalesce(F.col("coverage").cast("long"), "known").alias("n"))


@query(f"""WITH {_SQL_STORE} SELECT 'c' || i AS collection_id, (SELECT count(*) FROM counts c WHERE c.collection_id = 'c' || i AND c.notation IN (SELECT notation FROM nodes)) AS known_notations FROM range(5) r(i)""")
def kept_totals(spark, d):
    v = opened(spark, d)
    return overlay.kept_totals(v.info, v.sums).select("collection_id", "known_notations")


# Files in parts


@query(f"""WITH {_SQL_CALLS} SELECT tool, count(*) AS calls, false AS refused FROM e GROUP BY 1 UNION ALL SELECT 'a missing part', 0, true""")
def split_log(spark, d):
    """A gzipped log in parts, read as one stream; without one of its parts it is refused."""
    folder = work_folder(spark)
    _log_lines(spark, d).select("value").repartition(4).write.option("compression", "gzip").text(f"{folder}/members")
    place = spark._jvm.org.apache.hadoop.fs.Path
    fs = place(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    names = sorted(s.getPath().getName() for s in fs.listStatus(place(f"{folder}/members")) if s.getPath().getName().endswith(".gz"))
    for i, name in enumerate(names):  # members of one stream
        fs.rename(place(f"{folder}/members/{name}"), place(f"{folder}/log.gz.part-a{chr(97 + i)}"))
    calls = logs.calls(parts.read_lines(spark, [f"{folder}/log.gz"]))
    calls.groupBy("tool").agg(F.count(F.lit(1)).alias("calls")).write.parquet(f"{folder}/calls")
    fs.delete(place(f"{folder}/log.gz.part-ab"), False)
    try:
        parts.read_lines(spark, [f"{folder}/log.gz"])
        refused = False
    except parts.Incomplete:
        refused = True
    said = spark.createDataFrame([("a missing part", 0, refused)], "tool string, calls long, refused boolean")
    return spark.read.parquet(f"{folder}/calls").withColumn("refused", F.lit(False)).unionByName(said)


# Logs

_LANGS = ("en", "nl", "xx", "de", "")
_SQL_ARGS = f"""a AS (SELECT event_id, event_type, CAST(trunc(value) AS BIGINT) AS n, event_id % 5 - 1 AS off, {list(_LANGS)}[user_id % 5 + 1] AS lang, event_id % 4 AS way FROM events)"""


@query(f"""WITH {_SQL_ARGS} SELECT event_id, CASE WHEN lang IN ('xx', '') THEN 'unknown language ''' || lang || '''' WHEN off < 0 THEN 'offset must be a whole number from 0'
WHEN event_type = 'click' AND way IN (0, 3) THEN 'give a query or a semantic query, and not both' WHEN event_type = 'click' AND (n < 1 OR n > 50) THEN 'max_results must be a whole number from 1 to 50'
WHEN event_type = 'view' AND (way < 1 OR way > 3) THEN 'depth must be a whole number from 1 to 3' WHEN event_type IN ('signup', 'logout') AND (n % 30 < 1 OR n % 30 > 25) THEN 'number of notations must be a whole number from 1 to 25'
WHEN event_type = 'purchase' AND (n < 1 OR n > 100) THEN 'max_results must be a whole number from 1 to 100' WHEN event_type NOT IN ('click', 'view', 'signup', 'logout', 'purchase') AND (n < 1 OR n > 335) THEN 'max_results must be a whole number from 1 to 335'
WHEN event_type NOT IN ('click', 'view', 'signup', 'logout', 'purchase') AND way = 0 THEN 'x(+1) is a variant; ask for x' END AS refusal FROM a""")
def refused_calls(spark, d):
    """Which calls of a log the API would refuse, and why; blank texts count as none."""
    ship(spark)

    def arguments(kind: str, n: int, off: int, lang: str, way: int) -> tuple[str, dict]:
        own = {"offset": off, "lang": lang}
        if kind == "click":
            return "search", own | {"query": ("a", "a", "", "null")[way], "semantic": ("b", "", "b", None)[way], "max_results": n}
        if kind == "view":
            return "browse", own | {"depth": way}
        if kind in ("signup", "logout"):
            return "resolve" if kind == "signup" else "find_artworks", own | {"notations": ["x"] * (n % 30)}
        if kind == "purchase":
            return "search_prefix", own | {"max_results": n}
        return "expand_keys", own | {"notation": "x(+1)" if way == 0 else "x", "max_results": n}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(i).to_pylist() for i in range(1, 6)))
            yield pa.record_batch([batch.column(0), pa.array([engine.refusal(*arguments(*r)) for r in rows], pa.string())], names=["event_id", "refusal"])

    lang = F.element_at(F.array(*(F.lit(x) for x in _LANGS)), (F.col("user_id") % 5 + 1).cast("int"))
    rows = table(spark, d, "events").select("event_id", "event_type", F.col("value").cast("long").alias("n"), (F.col("event_id") % 5 - 1).alias("off"), lang.alias("lang"), (F.col("event_id") % 4).alias("way"))
    return rows.mapInArrow(run, "event_id long, refusal string")


@query(f"""WITH {_SQL_CALLS}, u AS (SELECT e.*, user_id FROM e JOIN events ON event_id = ord), s AS (SELECT *, sum(CASE WHEN before IS NULL OR ts - before > INTERVAL 60 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, ord) AS session
FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, ord) AS before FROM u))
SELECT user_id, min(ts) AS start, max(ts) AS "end", count(*) AS calls, count(*) - count(DISTINCT (tool, k)) AS repeats, count(DISTINCT tool) AS tools, count(*) FILTER (NOT ok) AS errors, count(*) FILTER (tool = 'search' AND k % 2 = 1) AS semantic,
CASE WHEN count(*) FILTER (tool = 'search' AND k % 2 = 1) > 3 THEN 'concept-search' WHEN count(*) FILTER (tool = 'browse') > 5 THEN 'hierarchy-exploration' WHEN count(*) FILTER (tool = 'find_artworks') > 3 THEN 'collection-discovery'
WHEN count(*) FILTER (tool = 'resolve') > 5 AND count(DISTINCT tool) <= 2 THEN 'batch-resolution' WHEN count(*) <= 3 AND max(ts) - min(ts) < INTERVAL 2 MINUTE THEN 'quick-lookup' ELSE 'browsing' END AS class FROM s GROUP BY user_id, session""")
def stream_sessions(spark, d):
    """Sessions by user, kept by a stream with state that is stopped half-way and started again."""
    folder = work_folder(spark)
    users = table(spark, d, "events").select(F.col("event_id").alias("ord"), "user_id")
    calls = logs.calls(_log_lines(spark, d)).join(users, "ord").select("ord", "user_id", "ts", "tool", "ms", "ok", "input")
    middle = calls.agg(F.percentile_approx("ts", 0.5)).first()[0]
    last = spark.range(1).select(F.lit(-1).cast("long").alias("ord"), F.lit(-1).cast("long").alias("user_id"), F.lit(datetime(2100, 1, 1)).alias("ts"), F.lit("resolve").alias("tool"), F.lit(0).cast("long").alias("ms"), F.lit(True).alias("ok"), F.lit("{}").alias("input"))
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    sessions.with_state_store(spark)
    try:
        for part in (calls.where(F.col("ts") <= F.lit(middle)), calls.where(F.col("ts") > F.lit(middle)), last.select(*calls.columns)):
            part.coalesce(1).write.mode("append").parquet(f"{folder}/in")
            stream = spark.readStream.schema(calls.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
            sessions.keep_appended(sessions.of_calls(stream, ["user_id"]), f"{folder}/out", f"{folder}/state").awaitTermination()
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)
    got = spark.read.parquet(f"{folder}/out")
    return got.select("user_id", "start", "end", "calls", "repeats", "tools", "errors", "semantic", "class")


@query(f"""WITH {_SQL_CALLS}, l AS (SELECT tool, list_sort(list(ms)) AS l, count(*) FILTER (NOT ok) AS bad FROM e GROUP BY 1), s AS (SELECT ts, sum(CASE WHEN before IS NULL OR ts - before > INTERVAL 60 MINUTE THEN 1 ELSE 0 END) OVER (ORDER BY ts, ord) AS session FROM (SELECT *, lag(ts) OVER (ORDER BY ts, ord) AS before FROM e)),
byday AS (SELECT CAST(CAST(b AS DATE) AS VARCHAR) AS day, count(*) AS n, CAST(sum(c) AS BIGINT) AS calls FROM (SELECT session, min(ts) AS b, count(*) AS c FROM s GROUP BY 1) GROUP BY 1)
SELECT 'Traffic' AS section, concat_ws('|', tool, len(l), bad, l[1], {_at(50)}, l[len(l)], round(100 * bad / len(l), 1)) AS cells FROM l
UNION ALL SELECT 'Latency', concat_ws('|', tool, {_at(50)}, {_at(90)}, {_at(99)}, l[len(l)], len(l)) FROM l
UNION ALL SELECT 'Errors', concat_ws('|', strftime(ts, '%Y-%m-%d %H:%M:%S.%f'), tool, error) FROM e WHERE NOT ok
UNION ALL SELECT 'Sessions by day', concat_ws('|', day, n, calls) FROM byday
UNION ALL SELECT 'Totals', concat_ws('|', (SELECT count(*) FROM e), (SELECT count(*) FROM e WHERE NOT ok), round(100 * (SELECT count(*) FROM e WHERE NOT ok) / (SELECT count(*) FROM e), 2), (SELECT CAST(max(session) AS BIGINT) FROM s))""")
def log_report_cells(spark, d):
    """The cells of the report's main tables, as its reader sees them."""
    tables = logs.sections(_log_lines(spark, d), store="Shop")
    rows = logs.report_lines({k: tables[k] for k in ("Traffic", "Latency", "Errors", "Sessions by day", "Totals")})
    cells, first = F.col("cells"), F.col("cells")[0]
    at = F.date_format(F.when(F.col("section") == "Errors", first).cast("timestamp"), "yyyy-MM-dd HH:mm:ss.SSSSSS")
    shown = F.when(F.col("section") == "Errors", F.concat(F.array(at), F.slice(cells, 2, 100))).when(F.col("section") == "Totals", F.slice(cells, 1, 4)).otherwise(cells)
    return rows.select("section", F.array_join(shown, "|").alias("cells"))
