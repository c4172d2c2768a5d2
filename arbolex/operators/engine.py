"""The public queries: search, browse, resolve, expand_keys, search_prefix, find_artworks, health.

Arguments are checked as strictly as the operators' contracts say. A result holds the page's rows, which are few, as
plain dicts, and totals; everything before the page is a DataFrame plan.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from arbolex.functions import scalars
from arbolex.operators import hierarchy, overlay, resolve, text, vector
from arbolex.sources.store import Vocabulary, metadata

LANGUAGES = ("en", "nl", "de", "fr", "it", "es", "pt", "fi", "cz", "hu", "pl", "jp", "zh")
CANDIDATES = 4096


class InvalidArgument(ValueError):
    pass


def _whole(name: str, value: int, low: int, high: int | None = None) -> int:
    if isinstance(value, bool) or not isinstance(value, int) or value < low or (high is not None and value > high):
        raise InvalidArgument(f"{name} must be a whole number from {low}" + (f" to {high}" if high is not None else ""))
    return value


def _language(lang: str) -> str:
    if lang not in LANGUAGES:
        raise InvalidArgument(f"unknown language {lang!r}")
    return lang


def check(tool: str, **a) -> None:
    """Refuses arguments that a query does not take; those left out have their defaults, which are fine."""
    _language(a.get("lang", "en"))
    _whole("offset", a.get("offset", 0), 0)
    if tool == "search":
        if (blank_to_none(a.get("query")) is None) == (blank_to_none(a.get("semantic")) is None):
            raise InvalidArgument("give a query or a semantic query, and not both")
        _whole("max_results", a.get("max_results", 25), 1, 50)
    elif tool == "browse":
        _whole("max_key_variants", a.get("max_key_variants", 25), 1, 335), _whole("key_offset", a.get("key_offset", 0), 0), _whole("depth", a.get("depth", 1), 1, 3)
    elif tool in ("resolve", "find_artworks"):
        _whole("number of notations", len(a["notations"]), 1, 25)
    elif tool == "expand_keys":
        _whole("max_results", a.get("max_results", 25), 1, 335)
        if "(+" in a["notation"]:
            raise InvalidArgument(f"{a['notation']} is a variant; ask for {a['notation'].split('(')[0]}")
    elif tool == "search_prefix":
        _whole("max_results", a.get("max_results", 25), 1, 100)
    else:
        raise InvalidArgument(f"unknown query {tool}")


def refusal(tool: str, arguments: dict) -> str | None:
    """Why a call would be refused before it reaches the tables, or None."""
    try:
        check(tool, **arguments)
    except InvalidArgument as e:
        return str(e)
    except (KeyError, TypeError) as e:
        return f"bad arguments: {e}"


def blank_to_none(value: str | None) -> str | None:
    return None if value is None or value in ("", "null") else value


def logged(method: Callable) -> Callable:
    """Emits one JSON line for each call, and counts it."""

    @wraps(method)
    def call(self, *args, **kwargs):
        began, error = time.time(), None
        try:
            return method(self, *args, **kwargs)
        except Exception as e:
            error = str(e)
            raise
        finally:
            shown = {k: [*v[:5], f"+{len(v) - 5} more"] if isinstance(v, list) and len(v) > 5 else v for k, v in kwargs.items()}
            line = {"tool": method.__name__, "ms": round((time.time() - began) * 1000), "ok": error is None, "input": shown} | ({"error": error} if error else {})
            self.emit(json.dumps(line, ensure_ascii=False, default=str))

    return call


def _plain(x):
    if isinstance(x, Row):
        return {k: _plain(v) for k, v in x.asDict().items()}
    return [_plain(v) for v in x] if isinstance(x, list) else x


def paged(hits: DataFrame, n: int, offset: int = 0) -> DataFrame:
    """A page of hits: the most widely held first, then the best rank, then by code as a reader would sort it."""
    return hits.orderBy(F.desc("coverage"), "rank", F.collate("notation", "UNICODE"), "notation").offset(offset).limit(n)


class Engine:
    """Queries over one vocabulary. ``embed`` turns a text into a vector, and gets queries with ``query_prefix`` before
    them, as models that were trained so need; without it there is no semantic search. A semantic search filters by
    collection before the nearest are taken, so a page is full where it can be; with ``filter_after`` it takes more of them
    and filters then, which may give less."""

    def __init__(
        self, v: Vocabulary, embed: Callable[[str], list[float]] | None = None, aggregator: str = "https://example.org/resource/?uri={code}", emit: Callable[[str], None] = lambda line: None,
        query_prefix: str = "", filter_after: bool = False,
    ):
        self.v, self.embed, self.aggregator, self.emit = v, embed, aggregator, emit
        self.query_prefix, self.filter_after = query_prefix, filter_after
        self.spark = v.notations.sparkSession
        self._collections: list[dict] | None = None

    # Pieces

    def _page(self, codes: list[str]) -> DataFrame:
        return self.spark.createDataFrame(list(enumerate(codes)), "pos int, notation string")

    def _entries(self, codes: list[str], lang: str) -> list[dict]:
        return [_plain(r) for r in resolve.entries(self.v, self._page(codes), lang).drop("pos").collect()] if codes else []

    def _scope(self, prefix: str | None) -> Column | None:
        """On the stored lower-case codes of the indexes and vectors, so that it reaches their scans."""
        return scalars.has_prefix("notation_lc", prefix) if prefix else None

    def collections(self) -> list[dict]:
        """Every collection with its total; read once, as an engine's store does not change."""
        if self._collections is None:
            self._collections = [_plain(r) for r in overlay.kept_totals(self.v.info, self.v.sums).orderBy("collection_id").collect()]
        return [dict(c) for c in self._collections]

    def matches(self, query: str, parent: str | None = None, collection: str | None = None, only_held: bool = False) -> DataFrame:
        """All hits of a keyword search, with rank and coverage, persisted. The AND of the words is looked up only where the
        phrase has no hit in any index."""
        scope = self._scope(parent)
        found = None
        for form in (text.phrase_tokens(query), text.term_tokens(query)):
            if found is not None:
                found.unpersist()
            found = text.all_hits(self.v.searchers(), form, "notation", scope).persist()
            if not form or not found.isEmpty():
                break
        hits = overlay.kept_coverage(found, self.v.sums, collection)
        hits = (hits.where("coverage > 0") if collection or only_held else hits).persist()
        hits.count()
        found.unpersist()
        return hits

    # Queries

    @logged
    def search(self, query: str | None = None, semantic: str | None = None, max_results: int = 25, lang: str = "en", offset: int = 0, collection: str | None = None, only_held: bool = False, parent: str | None = None) -> dict:
        query, semantic = blank_to_none(query), blank_to_none(semantic)
        collection, parent = blank_to_none(collection), blank_to_none(parent)
        check("search", query=query, semantic=semantic, max_results=max_results, offset=offset, lang=lang)
        if semantic is not None:
            return self._semantic(semantic, max_results, lang, offset, collection, only_held, parent)
        hits = self.matches(query, parent, collection, only_held)
        try:
            total = hits.count()
            page = [r["notation"] for r in paged(hits, max_results, offset).collect()]
        finally:
            hits.unpersist()
        return {"query": query, "total": total, "results": self._entries(page, lang), "collections": self.collections()}

    def _semantic(self, query: str, n: int, lang: str, offset: int, collection: str | None, only_held: bool, parent: str | None) -> dict:
        if self.embed is None or "embeddings" in self.v.missing:
            raise InvalidArgument("semantic search is not available")
        v = self.embed(self.query_prefix + query)
        expected = metadata(self.v).get("embedding_dimensions", "768")
        if len(v) != int(expected):
            raise InvalidArgument(f"the query vector has {len(v)} dimensions, the store {expected}")
        keep = None
        if collection or only_held:
            keep = self.v.counts.where(F.col("collection_id") == collection) if collection else self.v.counts
        k = min(offset + n, CANDIDATES)
        if self.filter_after:
            near = vector.nearest_then_kept(self.v.embeddings, "notation", vector.quantize_query(v), k, keep, self._scope(parent))
        else:
            near = vector.nearest_many(self.v.embeddings, "notation", {query: vector.quantize_query(v)}, k, self.v.clusters, keep, self._scope(parent))
        rows = near.select("notation", vector.similarity(F.col("distance")).alias("similarity"), "distance").orderBy("distance", "notation").collect()
        at = {r["notation"]: r["similarity"] for r in rows}
        found = [e | {"similarity": at[e["notation"]]} for e in self._entries([r["notation"] for r in rows], lang)]
        return {"query": query, "total": len(found), "results": found[offset : offset + n], "collections": self.collections()}

    @logged
    def browse(self, notation: str, lang: str = "en", include_keys: bool = False, max_key_variants: int = 25, key_offset: int = 0, depth: int = 1) -> dict:
        check("browse", lang=lang, max_key_variants=max_key_variants, key_offset=key_offset, depth=depth)
        own = self._entries([notation], lang)
        if not own:
            raise InvalidArgument(f"{notation} is not known")
        entry = own[0]
        root = self.v.notations.where(F.col("notation") == notation)
        tree = hierarchy.subtree(self.v.notations, root, depth).collect()
        below = [e | {"depth": t["depth"], "total_children": t["total_children"], "truncated": t["truncated"]} for e, t in zip(self._entries([t["notation"] for t in tree], lang), tree)]
        variants, total = [], 0
        if include_keys and not entry["is_key_expanded"]:
            variants, total = self._variants(notation, lang, max_key_variants, key_offset)
        known = self._entries(entry["refs"], lang)
        seen = {e["notation"] for e in known}
        refs = known + [{"notation": r, "text": None} for r in entry["refs"] if r not in seen]
        return {"notation": notation, "entry": entry, "subtree": below, "refs": refs, "key_variants": variants, "total_key_variants": total, "collections": self.collections()}

    def _variants(self, notation: str, lang: str, n: int, offset: int) -> tuple[list[dict], int]:
        rows = self.v.notations.where(F.col("base_notation") == notation)
        page = rows.orderBy("notation").offset(offset).limit(n).select("notation").collect()
        return self._entries([r["notation"] for r in page], lang), rows.count()

    @logged
    def resolve(self, notations: list[str], lang: str = "en") -> list[dict]:
        check("resolve", lang=lang, notations=notations)
        found = self._entries(notations, lang)
        if not found:
            raise InvalidArgument("none of the notations is known")
        return found

    @logged
    def expand_keys(self, notation: str, lang: str = "en", max_results: int = 25, offset: int = 0) -> dict:
        check("expand_keys", notation=notation, lang=lang, max_results=max_results, offset=offset)
        base = self._entries([notation], lang)
        if not base:
            raise InvalidArgument(f"{notation} is not known")
        variants, total = self._variants(notation, lang, max_results, offset)
        return {"notation": notation, "base": base[0], "key_variants": variants, "total_key_variants": total}

    @logged
    def search_prefix(self, prefix: str, max_results: int = 25, lang: str = "en", offset: int = 0, collection: str | None = None) -> dict:
        check("search_prefix", lang=lang, max_results=max_results, offset=offset)
        prefix, collection = prefix.strip(), blank_to_none(collection)
        if not prefix:
            return {"prefix": prefix, "total": 0, "results": [], "collections": self.collections()}
        rows = self.v.notations.where(scalars.has_prefix("notation_lc", prefix)).select("notation")
        if collection:
            rows = overlay.present(rows, self.v.counts, collection)
        page = rows.orderBy("notation").offset(offset).limit(max_results).collect()
        return {"prefix": prefix, "total": rows.count(), "results": self._entries([r["notation"] for r in page], lang), "collections": self.collections()}

    @logged
    def find_artworks(self, notations: list[str], lang: str = "en") -> list[dict]:
        check("find_artworks", lang=lang, notations=notations)
        page = self._page(notations)
        names = resolve.labels(self.v.texts.join(F.broadcast(page.select("notation").distinct()), "notation", "left_semi"), lang)
        return [_plain(r) for r in overlay.holdings(page, names, self.v.counts, self.v.info, self.aggregator).drop("pos").collect()]

    def health(self) -> dict:
        return {"ready": True, "collections": [c["collection_id"] for c in self.collections()], "embeddings": "embeddings" not in self.v.missing, "version": metadata(self.v)}

    def warm(self) -> int:
        """Caches the tables that every query reads."""
        return sum(df.cache().count() for df in (self.v.notations, self.v.label_index, self.v.keyword_index, self.v.counts))


def describe_entry(e: dict, prefix: str = "") -> str:
    """An entry on one line."""
    held = f" ({', '.join(e['collections'])})" if e["collections"] else ""
    path = f" [{' > '.join(p['notation'] for p in e['path'])}]" if e["path"] else ""
    return f'{prefix}{e["notation"]}{held} "{e["text"]}"{path}'


def describe_page(result: dict, offset: int = 0) -> str:
    """A search's result as text beside the structured one: how many there are, and numbered lines."""
    lines = [describe_entry(e, f"{i}. ") + (f" {e['similarity']:.3f}" if "similarity" in e else "") for i, e in enumerate(result["results"], offset + 1)]
    return "\n".join([f"{result['total']} results", *lines])
