"""Chat formatting with tool-call linking.

A turn's text may hold ``<tool_call>{"id", "name", "arguments"}</tool_call>`` and
``<tool_result>{"id", "content"}</tool_result>`` blocks, and a system turn ``<tools>[{"name", "parameters"}, ...]</tools>``
blocks that declare the tools of the conversation with their JSON schemas; what is left of the text is its message.
Calls and results are hash-joined by (conv_id, id), calls with the schemas by (conv_id, name), every part is serialised as
canonical JSON (sorted keys, no spaces), and all parts get keys that order them topologically: after the calls whose
ids their arguments name, a result after its call, and otherwise as they stood. Arguments name a call as ``{"$ref": id}``,
or as ``"$id"`` where the conversation has a call of that id; any other text that begins with a dollar is just text.

A part is one row; a conversation is never gathered in one task, so a conversation with a third of all rows is no
hot group. Sorting by (conv_id, order_turn, order_part, order_level, turn, part) gives the linked conversation. The depth of a call
is found in rounds over the dependency edges, written to the shared checkpoint folder. A round settles all calls whose
references are settled, and lets every edge to a call with one open reference jump to where that one leads, so a chain of n
calls takes about log2(n) rounds. Rounds go on while they settle anything; what is left then is on a cycle or waits for one.

Defined cases: a null text is an empty message; a block that is no JSON object or has no id is kept as a part with an
error; of several calls or results with one id the first (by turn and place) counts and the others are errors, as are
results without a call, calls without a result, unknown tools, arguments that break their schema or whose schema says what is not
checked here, and cyclic or unknown references.
Of several schemas for one name the conversation's first counts, then the ones passed in. Where a conversation declares
no tools and none are passed in, there is nothing to check names and arguments against. Rows without a conv_id
are never linked; repeated rows are repeated parts; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_right
from collections.abc import Iterator
from fractions import Fraction
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpointed

TAG = re.compile(r"<(/?)(tool_call|tool_result|tools)>")
TYPES = {"string": str, "object": dict, "array": list, "boolean": bool, "null": type(None)}


def canonical_json(value: object) -> str:
    """Sorted keys, no spaces, integral floats as integers."""

    def plain(x):
        if isinstance(x, dict):
            return {k: plain(v) for k, v in x.items()}
        if isinstance(x, list):
            return [plain(v) for v in x]
        return int(x) if isinstance(x, float) and x.is_integer() and abs(x) < 1 << 53 else x

    return json.dumps(plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def is_reference(value: object, calls: frozenset[str] = frozenset()) -> bool:
    """Whether an argument stands for the result of a call; ``calls`` are those that a bare ``$id`` may name."""
    if isinstance(value, str):
        return value.startswith("$") and value[1:] in calls
    return isinstance(value, dict) and set(value) == {"$ref"} and isinstance(value["$ref"], str)


class Unsupported(ValueError):
    """A schema that says something which is not checked here."""


# Keywords of JSON Schema that describe and do not restrict.
ANNOTATIONS = frozenset("title description default examples deprecated readOnly writeOnly format contentEncoding contentMediaType $schema $id $anchor $comment $defs definitions".split())
MOST_DEPTH = 100


def equal(a: object, b: object) -> bool:
    """Equality of JSON values: numbers by value, and a boolean is no number."""
    if isinstance(a, bool) or isinstance(b, bool):
        return a is b
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(equal(v, b[k]) for k, v in a.items())
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(equal, a, b))
    return type(a) is type(b) and a == b or isinstance(a, (int, float)) and isinstance(b, (int, float)) and a == b


def _is(kind: str, value: object) -> bool:
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    if kind == "number":
        return number
    if kind == "integer":
        return number and (isinstance(value, int) or value.is_integer())
    if kind not in TYPES:
        raise Unsupported(f"type {kind}")
    return isinstance(value, TYPES[kind]) and (kind == "boolean") == isinstance(value, bool)


def _multiple(value: float, of: float) -> bool:
    return Fraction(str(value)) % Fraction(str(of)) == 0


def _found(pattern: str, text: str) -> bool:
    return re.search(pattern, text) is not None


def _pointed(root: object, ref: str) -> object:
    if not isinstance(ref, str) or not (ref == "#" or ref.startswith("#/")):
        raise Unsupported(f"$ref {ref}")
    for step in ref[2:].split("/") if ref != "#" else []:
        step = unquote(step).replace("~1", "/").replace("~0", "~")
        try:
            root = root[int(step)] if isinstance(root, list) else root[step]
        except (KeyError, IndexError, TypeError, ValueError) as e:
            raise Unsupported(f"$ref {ref}") from e
    return root


def _unequal(values: list) -> bool:
    """Whether all are different: by their canonical text, in which numbers of one value agree."""
    texts = [canonical_json(v) for v in values]
    return len(set(texts)) == len(texts)


class Checked:
    """A value held against a JSON schema. ``calls``: ids that a bare ``$id`` may name; such arguments are not known yet."""

    def __init__(self, root: object, calls: frozenset[str] = frozenset()):
        self.root, self.calls = root, calls

    def error(self, value: object, schema: object, at: str = "$", depth: int = 0) -> str | None:
        """The first thing that is wrong, keyword by keyword."""
        if is_reference(value, self.calls) or schema is True:
            return None
        if schema is False:
            return f"{at}: not allowed"
        if not isinstance(schema, dict):
            raise TypeError("a schema is an object or a boolean")
        if depth > MOST_DEPTH:
            raise Unsupported("too deep")
        for word in schema:
            if word not in ANNOTATIONS and word not in self.WORDS:
                raise Unsupported(str(word))
        for word, test in self.WORDS.items():
            if word in schema and (wrong := test(self, value, schema[word], schema, at, depth + 1)):
                return wrong
        return None

    def _type(self, value, want, schema, at, depth):
        kinds = [want] if isinstance(want, str) else want
        return None if any([_is(k, value) for k in kinds]) else f"{at}: not {' or '.join(kinds)}"

    def _some(self, value, options, at, depth):
        return sum(self.error(value, o, at, depth) is None for o in options)

    def _all(self, value, options, at, depth):
        return next((e for o in options if (e := self.error(value, o, at, depth))), None)

    def _branch(self, value, test, schema, at, depth):
        way = "then" if self.error(value, test, at, depth) is None else "else"
        return self.error(value, schema[way], at, depth) if way in schema else None

    def _required(self, value, names, schema, at, depth):
        return next((f"{at}.{k}: missing" for k in names if k not in value), None) if isinstance(value, dict) else None

    def _properties(self, value, known, schema, at, depth):
        return self._all_of(((value[k], known[k], f"{at}.{k}") for k in sorted(value) if k in known), depth) if isinstance(value, dict) else None

    def _all_of(self, cases, depth):
        return next((e for v, s, a in cases if (e := self.error(v, s, a, depth))), None)

    def _patterned(self, value, known, schema, at, depth):
        return self._all_of(((value[k], s, f"{at}.{k}") for k in sorted(value) for p, s in known.items() if _found(p, k)), depth) if isinstance(value, dict) else None

    def _additional(self, value, rest, schema, at, depth):
        if not isinstance(value, dict):
            return None
        more = [k for k in sorted(value) if k not in schema.get("properties", {}) and not any(_found(p, k) for p in schema.get("patternProperties", {}))]
        if rest is False:
            return f"{at}.{more[0]}: unknown" if more else None
        return self._all_of(((value[k], rest, f"{at}.{k}") for k in more), depth)

    def _dependent(self, value, needs, schema, at, depth):
        return next((f"{at}.{k}: missing" for n in sorted(needs) if isinstance(value, dict) and n in value for k in needs[n] if k not in value), None)

    def _prefix(self, value, each, schema, at, depth):
        return self._all_of(((v, s, f"{at}[{i}]") for i, (v, s) in enumerate(zip(value, each))), depth) if isinstance(value, list) else None

    def _items(self, value, each, schema, at, depth):
        if isinstance(each, list):  # the older form of prefixItems
            return self._prefix(value, each, schema, at, depth)
        begin = len(schema.get("prefixItems", []))
        return self._all_of(((v, each, f"{at}[{i}]") for i, v in enumerate(value) if i >= begin), depth) if isinstance(value, list) else None

    def _contains(self, value, each, schema, at, depth):
        return f"{at}: contains" if isinstance(value, list) and not any(self.error(v, each, at, depth) is None for v in value) else None

    def _names(self, value, each, schema, at, depth):
        return self._all_of(((k, each, f"{at}.{k}") for k in sorted(value)), depth) if isinstance(value, dict) else None

    def _ref(self, value, ref, schema, at, depth):
        return self.error(value, _pointed(self.root, ref), at, depth)

    @staticmethod
    def _bound(kind, said, holds):
        """A keyword that bounds numbers, or the length of a text, list or object."""
        return lambda self, v, want, schema, at, depth: None if not kind(v) or holds(v, want) else f"{at}: {said}"


_is_number = lambda v: _is("number", v)
_is_kind = lambda k: lambda v: isinstance(v, k)
#: In this order they are checked.
Checked.WORDS = {
    "$ref": Checked._ref,
    "type": Checked._type,
    "enum": lambda self, v, want, s, at, d: None if any(equal(v, x) for x in want) else f"{at}: not in enum",
    "const": lambda self, v, want, s, at, d: None if equal(v, want) else f"{at}: not const",
    "minimum": Checked._bound(_is_number, "below minimum", lambda v, w: v >= w),
    "maximum": Checked._bound(_is_number, "above maximum", lambda v, w: v <= w),
    "exclusiveMinimum": Checked._bound(_is_number, "below exclusiveMinimum", lambda v, w: v > w),
    "exclusiveMaximum": Checked._bound(_is_number, "above exclusiveMaximum", lambda v, w: v < w),
    "multipleOf": Checked._bound(_is_number, "multipleOf", _multiple),
    "minLength": Checked._bound(_is_kind(str), "length", lambda v, w: len(v) >= w),
    "maxLength": Checked._bound(_is_kind(str), "length", lambda v, w: len(v) <= w),
    "pattern": Checked._bound(_is_kind(str), "pattern", lambda v, w: _found(w, v)),
    "minItems": Checked._bound(_is_kind(list), "minItems", lambda v, w: len(v) >= w),
    "maxItems": Checked._bound(_is_kind(list), "maxItems", lambda v, w: len(v) <= w),
    "uniqueItems": Checked._bound(_is_kind(list), "uniqueItems", lambda v, w: not w or _unequal(v)),
    "minProperties": Checked._bound(_is_kind(dict), "minProperties", lambda v, w: len(v) >= w),
    "maxProperties": Checked._bound(_is_kind(dict), "maxProperties", lambda v, w: len(v) <= w),
    "required": Checked._required,
    "dependentRequired": Checked._dependent,
    "properties": Checked._properties,
    "patternProperties": Checked._patterned,
    "additionalProperties": Checked._additional,
    "propertyNames": Checked._names,
    "prefixItems": Checked._prefix,
    "items": Checked._items,
    "contains": Checked._contains,
    "allOf": lambda self, v, want, s, at, d: self._all(v, want, at, d),
    "anyOf": lambda self, v, want, s, at, d: None if self._some(v, want, at, d) else f"{at}: anyOf",
    "oneOf": lambda self, v, want, s, at, d: None if self._some(v, want, at, d) == 1 else f"{at}: oneOf",
    "not": lambda self, v, want, s, at, d: f"{at}: not" if self.error(v, want, at, d) is None else None,
    "if": Checked._branch,
    "then": lambda *_: None,
    "else": lambda *_: None,
}


def schema_error(value: object, schema: object, calls: frozenset[str] = frozenset()) -> str | None:
    """The first thing wrong with a value under a JSON schema; 'unsupported schema: ...' where the schema says something
    that is not checked here (the keywords are those of ``Checked.WORDS``, references to places in the same schema
    included), so that no rule is passed over in silence; 'bad schema' where a keyword's value makes no sense."""
    try:
        return Checked(schema, calls).error(value, schema)
    except Unsupported as e:
        return f"unsupported schema: {e}"
    except RecursionError:
        return "unsupported schema: too deep"
    except (TypeError, AttributeError, ValueError, ZeroDivisionError, re.error):
        return "bad schema"


def blocks(text: str) -> list[tuple[str, str, int, int]]:
    """(kind, content, start, end) of the blocks of a text: from the first opening tag to the next closing tag of its kind,
    and on from there. An opening tag that is never closed is text. Tags are found in one pass."""
    tags = [(m[2], bool(m[1]), m.start(), m.end()) for m in TAG.finditer(text)]
    closing: dict[str, list[int]] = {}
    for i, (kind, closes, _, _) in enumerate(tags):
        if closes:
            closing.setdefault(kind, []).append(i)
    out, i = [], 0
    while i < len(tags):
        kind, closes, start, end = tags[i]
        later = closing.get(kind, [])
        at = bisect_right(later, i)
        if closes or at == len(later):
            i += 1
            continue
        last = tags[later[at]]
        out.append((kind, text[end : last[2]], start, last[3]))
        i = later[at] + 1
    return out


def references(value: object) -> tuple[set[str], set[str]]:
    """Ids that arguments refer to, and those that they may mean by a bare ``$id``."""
    hard: set[str] = set()
    soft: set[str] = set()
    todo = [value]
    while todo:
        x = todo.pop()
        if is_reference(x):
            hard.add(x["$ref"])
        elif isinstance(x, str):
            if re.fullmatch(r"\$[A-Za-z0-9_-]+", x):
                soft.add(x[1:])
        elif isinstance(x, (list, dict)):
            todo += x.values() if isinstance(x, dict) else x
    return hard, soft


def _sound(x: object) -> str | None:
    """A text that is not empty and that UTF-8 can hold, or None."""
    return x if isinstance(x, str) and x and not re.search("[\ud800-\udfff]", x) else None


def _declared(body: object) -> list[tuple[str, str]] | None:
    """(name, schema as JSON) of the tools in a ``tools`` block: a list of {"name", "parameters"}, or of
    {"type": "function", "function": {...}} around the same."""
    items = body if isinstance(body, list) else [body]
    items = [x["function"] if isinstance(x, dict) and isinstance(x.get("function"), dict) else x for x in items]
    if not all(isinstance(x, dict) and _sound(x.get("name")) and isinstance(x.get("parameters", {}), dict) for x in items):
        return None
    return [(x["name"], json.dumps(x.get("parameters", {}))) for x in items]


def turn_parts(role: str | None, text: str | None) -> list[tuple]:
    """(kind, call_id, name, error, refs, may_refs, tools, json) of one turn, the message first unless there are only
    blocks. Tools are declared by system turns only; elsewhere such a block is part of the message."""
    text = text or ""
    found = [m for m in blocks(text) if m[0] != "tools" or role == "system"] if "<tool" in text else []
    rest, at = [], 0
    for m in found:
        rest.append(text[at : m[2]])
        at = m[3]
    rest = "".join([*rest, text[at:]]).strip() if found else text
    out = [("message", None, None, None, [], [], [], canonical_json({"role": role, "content": rest}))] if rest or not found else []
    for m in found:
        kind, error, body, call, name, refs, tools = m[0], None, None, None, None, (set(), set()), []
        try:
            body = json.loads(m[1])
            dumped = canonical_json(body)
            if _sound(dumped) is None:  # lone surrogates stay escaped
                dumped = json.dumps(json.loads(dumped), sort_keys=True, separators=(",", ":"))
        except (ValueError, RecursionError):
            body, dumped, error = None, canonical_json({"raw": m[1]}), "not JSON"
        if error is None and kind == "tools":
            tools = _declared(body)
            tools, error = (tools, None) if tools is not None else ([], "no tools")
        elif error is None and not isinstance(body, dict):
            error = "not an object"
        elif error is None:
            call, name = _sound(body.get("id")), _sound(body.get("name"))
            error = None if call else "no id"
            if kind == "tool_call":
                refs = references(body.get("arguments", {}))
        out.append((kind, call, name, error, *(sorted(x for x in r if _sound(x)) for r in refs), [{"tool": n, "schema": x} for n, x in tools], dumped))
    return out


PARTS = "conv_id long, turn long, part int, role string, kind string, call_id string, name string, error string, refs array<string>, may_refs array<string>, tools array<struct<tool: string, schema: string>>, json string"
_KEY = "struct<turn: long, part: int, level: long>"


def parsed(turns: DataFrame) -> DataFrame:
    """One row for each part of each turn."""
    texts = pa.list_(pa.string())
    kinds = [pa.int64(), pa.int64(), pa.int32(), *[pa.string()] * 5, texts, texts, pa.list_(pa.struct([("tool", pa.string()), ("schema", pa.string())])), pa.string()]
    names = "conv_id turn part role kind call_id name error refs may_refs tools json".split()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(c, t, k, r, *p) for c, t, r, x in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "turn", "role", "text"))) for k, p in enumerate(turn_parts(r, x))]
            cols = list(zip(*rows)) or [()] * len(kinds)
            yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

    return turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")).mapInArrow(run, PARTS)


def _call_keys(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, key, cyclic): keys that rise strictly along references, (turn, part, level): the latest place
    among the call and all that it leads to, and how many references away that is at most. calls: conv_id, call_id, own,
    refs, all of them calls."""
    edges = calls.select("conv_id", "call_id", F.explode(F.array_distinct("refs")).alias("ref"), F.lit(1).cast("long").alias("far"))
    edges = checkpointed(edges)
    plain = calls.select("conv_id", "call_id", F.col("own").alias("key"), F.lit(False).alias("cyclic"))
    open_ = edges.select("conv_id", "call_id").distinct().count()
    if not open_:
        return plain
    ends = edges.select("conv_id", "call_id").unionByName(edges.select("conv_id", F.col("ref").alias("call_id"))).distinct()
    nodes = checkpointed(calls.join(ends, ["conv_id", "call_id"], "left_semi").select("conv_id", "call_id", "own", F.col("own").alias("key")))
    plain = plain.join(nodes.select("conv_id", "call_id"), ["conv_id", "call_id"], "left_anti")
    at = ["conv_id", "call_id"]
    while open_:
        waits = edges.groupBy(*at).agg(F.count(F.lit(1)).alias("n"), F.first("ref").alias("next"), F.first("far").alias("step"))
        there = nodes.join(waits, at, "left").select("conv_id", F.col("call_id").alias("ref"), F.col("key").alias("got"), "n", "next", "step")
        seen = checkpointed(edges.join(there, ["conv_id", "ref"]))
        # What a reference is known to come after holds for the call too, settled or not.
        late = F.struct(F.col("got.turn").alias("turn"), F.col("got.part").alias("part"), (F.col("got.level") + F.col("far")).alias("level")).cast(_KEY)
        after = seen.groupBy(*at).agg(F.max(late).alias("late"))
        nodes = checkpointed(nodes.join(after, at, "left").select(*at, "own", F.greatest("key", "late").alias("key")))
        jumps = F.col("n") == 1
        edges = seen.where("n is not null").select(*at, F.when(jumps, F.col("next")).otherwise(F.col("ref")).alias("ref"), F.when(jumps, F.least(F.col("far") + F.col("step"), F.lit(1 << 40))).otherwise(F.col("far")).alias("far"))
        edges = checkpointed(edges.groupBy(*at, "ref").agg(F.max("far").alias("far")))
        before, open_ = open_, edges.select(*at).distinct().count()
        if open_ == before:
            break
    left = edges.select(*at, F.lit(True).alias("cyclic")).distinct()
    got = nodes.join(left, at, "left").select(*at, F.when(F.col("cyclic"), F.col("own")).otherwise(F.col("key")).alias("key"), F.coalesce("cyclic", F.lit(False)).alias("cyclic"))
    return plain.unionByName(got)


def _checked(rows: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """Adds bad: what is wrong with a call's tool or arguments. rows: name, json, schema, some (whether the conversation
    declares tools) and known (the calls that its bare references name)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bad = []
            for kind, name, error, dumped, schema, some, known in zip(*(batch.column(c).to_pylist() for c in ("kind", "name", "error", "json", "schema", "some", "known"))):
                wrong = None
                if kind == "tool_call" and error is None and (some or schemas):
                    own = json.loads(schema) if schema is not None else schemas.get(name)
                    wrong = "unknown tool" if own is None else schema_error(json.loads(dumped).get("arguments", {}), own, frozenset(known or ()))
                bad.append(wrong)
            yield batch.append_column("bad", pa.array(bad, pa.string()))

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("bad", T.StringType())]))


def linked(turns: DataFrame, schemas: dict[str, dict] | None = None) -> DataFrame:
    """Every part with what it is linked to, what is wrong with it, and its place in the topological order. ``schemas`` are
    those of tools that conversations need not declare."""
    own = F.struct(F.coalesce("turn", F.lit(-(1 << 62))).alias("turn"), F.col("part").alias("part"), F.lit(0).alias("level")).cast(_KEY)
    parts = checkpointed(parsed(turns).withColumn("own", own))
    at = ["conv_id", "call_id"]
    named = parts.where("conv_id is not null and call_id is not null and kind != 'tools'")
    firsts = named.groupBy(*at, "kind").agg(F.min(F.struct("own", "refs", "may_refs")).alias("x"))
    calls = firsts.where("kind = 'tool_call'").select(*at, F.col("x.own").alias("own"), F.col("x.refs").alias("refs"), F.col("x.may_refs").alias("may_refs"))
    results = firsts.where("kind = 'tool_result'").select(*at, F.col("x.own").alias("result_own"))
    ids = calls.select("conv_id", F.col("call_id").alias("ref"))
    hard = calls.select(*at, F.explode("refs").alias("ref"))
    bad = hard.join(ids, ["conv_id", "ref"], "left_anti").groupBy(*at).agg(F.min("ref").alias("bad_ref"))
    soft = calls.select(*at, F.explode("may_refs").alias("ref")).join(ids, ["conv_id", "ref"], "left_semi")
    known = soft.groupBy(*at).agg(F.collect_set("ref").alias("known"))  # as long as its call's arguments at most
    all_refs = hard.join(ids, ["conv_id", "ref"], "left_semi").select(*at, "ref").unionByName(soft.select(*at, "ref")).groupBy(*at).agg(F.collect_set("ref").alias("refs"))
    keys = _call_keys(calls.select(*at, "own").join(all_refs, at, "left"))
    link = calls.select(*at, F.col("own").alias("call_own")).join(keys, at).join(bad, at, "left").join(known, at, "left")
    link = link.join(results, at, "full")
    # Parts without an id have nothing to be joined with; among the keys, they would all be one hot null.
    alone = parts.where("conv_id is null or call_id is null or kind = 'tools'")
    rows = named.join(link, at, "left").unionByName(alone, allowMissingColumns=True).drop("tools", "refs", "may_refs")
    declared = parts.where("conv_id is not null").select("conv_id", "own", F.posexplode("tools").alias("k", "t"))
    tools = declared.groupBy("conv_id", F.col("t.tool").alias("name")).agg(F.min_by("t.schema", F.struct("own", "k")).alias("schema"))
    some = tools.select("conv_id", F.lit(True).alias("some")).distinct()
    is_call = F.col("kind") == "tool_call"
    rest = rows.where(~is_call | F.col("conv_id").isNull()).withColumns({"schema": F.lit(None).cast("string"), "some": F.lit(None).cast("boolean")})
    called = rows.where(is_call & F.col("conv_id").isNotNull()).join(tools, ["conv_id", "name"], "left").join(some, "conv_id", "left")
    rows = _checked(rest.unionByName(called), schemas or {})
    call, result = F.col("kind") == "tool_call", F.col("kind") == "tool_result"
    first = F.coalesce(F.when(call, F.col("own") == F.col("call_own")).when(result, F.col("own") == F.col("result_own")), F.lit(False))
    both = first & F.col("call_own").isNotNull() & F.col("result_own").isNotNull()
    error = (
        F.when(F.col("error").isNotNull(), F.col("error"))
        .when((call | result) & F.col("conv_id").isNotNull() & ~first, F.lit("repeated id"))
        .when(call & F.col("cyclic"), F.lit("cyclic reference"))
        .when(call & F.col("bad_ref").isNotNull(), F.concat(F.lit("unknown reference "), F.col("bad_ref")))
        .when(call & F.col("bad").isNotNull(), F.col("bad"))
        .when(call & ~both, F.lit("no result"))
        .when(result & ~both, F.lit("no call"))
    )
    after = F.struct(F.col("key.turn").alias("turn"), F.col("key.part").alias("part"), (F.col("key.level") + 1).alias("level")).cast(_KEY)
    place = F.when(call & first, F.col("key")).when(result & both, F.greatest("own", after)).otherwise(F.col("own"))
    rows = rows.withColumn("place", place)
    return rows.select(
        "conv_id", "turn", "part", "role", "kind", "call_id", "name", both.alias("linked"), error.isNull().alias("valid"), error.alias("error"),
        F.col("place.turn").alias("order_turn"), F.col("place.part").alias("order_part"), F.col("place.level").alias("order_level"), "json",
    )


def op9_tool_call_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No schemas are passed in: those that the conversations declare hold."""
    return linked(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
