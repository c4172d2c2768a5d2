"""Sessions of a stream with state: what ``logs.sessions`` says of a whole log, kept as calls come in.

Each key has its open sessions as state. A call joins those that are within the gap of it, which may make one of two, so
calls may come in any order down to the watermark; what a session keeps of them can be merged. A timer closes a session when the
watermark has passed its end by the gap. Calls later than the watermark are dropped, and counted (``dropped``). The state lies
in the checkpoint, so a stream goes on after a restart as if nothing had happened.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from arbolex.functions import scalars
from arbolex.operators import logs
from arbolex.session import ship

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
MOST_TOPICS = 20
_KINDS = ("semantic", "errors", "slow", *logs.TOOLS)
SESSION = "start timestamp, end timestamp, calls long, repeats long, tools long, slow long, errors long, semantic long, {tools}, topics array<string>".format(tools=", ".join(f"n_{t} long" for t in logs.TOOLS))


def summary(ts: int, ord_: int, tool: str, counts: list[int], topics: list[str], key: int) -> dict:
    """One call as a session of its own; times in microseconds."""
    return {"s": ts, "e": ts, "c": 1, "t": [tool], "k": [key], "n": counts, "p": [[ts, ord_, i, x] for i, x in enumerate(topics)]}


def merged(a: dict, b: dict, most: int = MOST_TOPICS) -> dict:
    """Two sessions as one. Of the topics the first ``most`` by their first call stay, which merging more never changes."""
    first: dict[str, list] = {}
    for x in sorted(a["p"] + b["p"]):
        first.setdefault(x[3], x)
    return {"s": min(a["s"], b["s"]), "e": max(a["e"], b["e"]), "c": a["c"] + b["c"], "t": sorted({*a["t"], *b["t"]}), "k": sorted({*a["k"], *b["k"]}), "n": [x + y for x, y in zip(a["n"], b["n"])], "p": sorted(first.values())[:most]}


def joined(open_: list[dict], new: list[dict], gap: int) -> list[dict]:
    """Sessions by time, those within the gap of each other made one. A gap of exactly ``gap`` still belongs together."""
    out: list[dict] = []
    for x in sorted([*open_, *new], key=lambda s: s["s"]):
        if out and x["s"] - out[-1]["e"] <= gap:
            out[-1] = merged(out[-1], x)
        else:
            out.append(x)
    return out


class Sessions(StatefulProcessor):
    """State: a key's open sessions as JSON. ``gap`` in microseconds."""

    def __init__(self, gap: int, keys: list[str]):
        self.gap, self.keys = gap, keys

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", T.StructType([T.StructField("json", T.StringType())]))

    def _kept(self) -> list[dict]:
        return json.loads(self.open.get()[0]) if self.open.exists() else []

    def _keep(self, found: list[dict]) -> None:
        """Stores what is open, with one timer for the first session that ends."""
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t[0] if isinstance(t, tuple) else t)
        if not found:
            self.open.clear()
            return
        self.open.update((json.dumps(found),))
        self.handle.registerTimer(min(x["e"] for x in found) // 1000 + self.gap // 1000 + 1)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = []
        for pdf in rows:
            for ts, ord_, tool, counts, topics, call in zip(pdf["x_ts"], pdf["x_ord"], pdf["x_tool"], pdf["x_n"], pdf["x_topics"], pdf["x_call"]):
                new.append(summary(int(ts), int(ord_), tool, [int(x) for x in counts], list(topics), int(call)))
        self._keep(joined(self._kept(), new, self.gap))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        found = self._kept()
        done = [x for x in found if x["e"] + self.gap < passed]
        self._keep([x for x in found if x["e"] + self.gap >= passed])
        if done:
            yield pd.DataFrame([(*key, *_row(x)) for x in done], columns=[*self.keys, *(c.split()[0] for c in SESSION.split(", "))])

    def close(self) -> None:
        pass


def _row(x: dict) -> tuple:
    at = lambda micros: datetime.fromtimestamp(micros / 1e6, timezone.utc).replace(tzinfo=None)
    by = dict(zip(_KINDS, x["n"]))
    return (at(x["s"]), at(x["e"]), x["c"], x["c"] - len(x["k"]), len(x["t"]), by["slow"], by["errors"], by["semantic"], *(by[t] for t in logs.TOOLS), [p[3] for p in x["p"]])


def of_calls(calls: DataFrame, by: list[str], gap: int = logs.GAP_SECONDS, late: str = "10 minutes", ts: str = "ts") -> DataFrame:
    """A stream of closed sessions by key: ``by``, start, end, calls, repeats (calls whose tool and input came before),
    tools, slow, errors, semantic, topics, seconds and class. ``calls``: a stream with ts, ord, tool, ms, ok and input, as
    ``logs.calls`` gives them, and the keys. Needs STATE_STORE as the session's state store."""
    ship(calls.sparkSession)
    semantic = (F.col("tool") == "search") & F.get_json_object("input", "$.semanticQuery").isNotNull()
    flags = {"semantic": semantic, "errors": ~F.col("ok"), "slow": F.col("ms") > logs.TAIL_MS} | {t: F.col("tool") == t for t in logs.TOOLS}
    rows = calls.withWatermark(ts, late).where(F.col(ts).isNotNull())
    rows = rows.select(  # names in Python's state processors must not begin with an underscore
        *by, ts, scalars.micros(ts).alias("x_ts"), F.col("ord").cast("long").alias("x_ord"), F.col("tool").alias("x_tool"),
        F.array(*(F.coalesce(flags[k].cast("int"), F.lit(0)) for k in _KINDS)).alias("x_n"),
        F.coalesce(logs.topics(F.col("tool"), F.col("input")), F.array().cast("array<string>")).alias("x_topics"),
        F.xxhash64("tool", scalars.canonical_object(F.col("input"))).alias("x_call"),
    )
    schema = T.StructType([*(calls.schema[c] for c in by), *T.StructType.fromDDL(SESSION).fields])
    got = rows.groupBy(*by).transformWithStateInPandas(Sessions(gap * 1_000_000, by), schema, "Append", "EventTime")
    got = got.withColumn("seconds", (scalars.micros("end") - scalars.micros("start")) / 1e6)
    kind = logs.session_class(F.col("semantic"), F.col("n_browse"), F.col("n_expand_keys"), F.col("n_find_artworks"), F.col("n_resolve"), F.col("tools"), F.col("calls"), F.col("seconds"))
    return got.withColumn("class", kind).drop(*(f"n_{t}" for t in logs.TOOLS))


def keep_appended(found: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends closed sessions to a Parquet table until what is there has been read; started again, it goes on."""
    return found.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def dropped(query: StreamingQuery) -> int:
    """How many calls a finished run dropped, as later than the watermark."""
    return sum(s.numRowsDroppedByWatermark for p in query.recentProgress for s in p.stateOperators)


def with_state_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
