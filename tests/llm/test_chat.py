import json
import random

import pytest

from arbolex.llm import chat

SCHEMAS = {"add": {"type": "object", "properties": {"a": {"type": "number"}, "b": {"type": "number", "maximum": 10}}, "required": ["a", "b"], "additionalProperties": False}}


def test_tool_calls(spark):
    call = lambda i, args, name="add": f'<tool_call>{{"name":"{name}", "id":"{i}","arguments":{args}}}</tool_call>'
    res = lambda i: f'<tool_result>{{"id":"{i}","content": 3.0}}</tool_result>'
    rows = [
        (1, 0, "user", "hi  there"),
        (1, 1, "assistant", "so " + call("c2", '{"a": "$c1", "b": 2}') + call("c1", '{"b": 1.0, "a": 2}')),
        (1, 2, "tool", res("c2") + res("c1")),
        (1, 3, "assistant", call("c3", '{"a": 1}') + call("c1", "{}") + "<tool_call>nope</tool_call>" + call("c4", '{"a":1,"b":11}') + call("c5", "{}", "who")),
        (1, 4, "tool", res("zz")),
        (2, 0, "assistant", call("x", '{"a": {"$ref": "y"}, "b": 1}') + call("y", '{"a": "$x", "b": 1}')),
        (2, 1, "tool", res("x") + res("y")),
        (3, 1, "tool", res("k")),
        (3, 2, "assistant", call("k", '{"a":1,"b":{"$ref":"gone"}}')),
        (None, 0, "assistant", call("c1", '{"a":1,"b":1}')),
        (4, None, None, None),
    ]
    turns = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, own string")
    out = chat.linked(turns, SCHEMAS).collect()
    key = lambda r: (r["conv_id"] or 0, r["order_turn"], r["order_part"], r["order_level"], r["turn"] or -1, r["part"])
    of = lambda c: [(r["kind"][5:] if r["kind"] != "message" else "m", r["call_id"], r["error"]) for r in sorted(out, key=key) if r["conv_id"] == c]
    assert of(1) == [
        ("m", None, None), ("m", None, None), ("call", "c1", None), ("call", "c2", None), ("result", "c2", None), ("result", "c1", None),
        ("call", "c3", "$.b: missing"), ("call", "c1", "repeated id"), ("call", None, "not JSON"), ("call", "c4", "$.b: above maximum"), ("call", "c5", "unknown tool"), ("result", "zz", "no call"),
    ]
    assert {e for _, _, e in of(2) if e} == {"cyclic reference"}
    assert [k for k, _, _ in of(3)] == ["call", "result"] and of(3)[0][2] == "unknown reference gone"
    assert len(of(4)) == 1 and of(None)[0][2] == "no result"
    assert next(r["json"] for r in out if r["call_id"] == "c1" and r["turn"] == 1) == '{"arguments":{"a":2,"b":1},"id":"c1","name":"add"}'
    assert chat.linked(turns.where("turn < -5"), SCHEMAS).count() == 0


TURNS = "conv_id long, turn long, role string, text string"


def block(kind, **body):
    return f"<{kind}>{json.dumps(body)}</{kind}>"


def test_text_with_a_dollar_is_no_reference(spark):
    schema = {"quote": {"type": "object", "properties": {"ticker": {"type": "string", "minLength": 4}, "n": {"type": "number"}}}}
    rows = [
        (1, 0, "a", block("tool_call", id="q1", name="quote", arguments={"ticker": "$AAPL"})),
        (1, 1, "a", block("tool_call", id="q2", name="quote", arguments={"ticker": "$1", "n": "$q1"})),
        (1, 2, "a", block("tool_call", id="q3", name="quote", arguments={"n": "$100"})),
        (2, 0, "a", block("tool_call", id="q1", name="quote", arguments={"ticker": "$AAPL", "n": [{"deep": "$q1"}]})),
    ]
    got = {(r["conv_id"], r["call_id"]): r["error"] for r in chat.linked(spark.createDataFrame(rows, TURNS), schema).collect()}
    assert got == {(1, "q1"): "no result", (1, "q2"): "$.ticker: length", (1, "q3"): "$.n: not number", (2, "q1"): "cyclic reference"}


def test_tools_that_a_conversation_declares(spark):
    add = {"name": "add", "parameters": SCHEMAS["add"]}
    good, bad, other = block("tool_call", id="1", name="add", arguments={"a": 1, "b": 2}), block("tool_call", id="2", name="add", arguments={"a": 1}), block("tool_call", id="3", name="sub", arguments={})
    done = "".join(block("tool_result", id=str(k), content=0) for k in (1, 2, 3))
    tools = f"<tools>{json.dumps([add, {'type': 'function', 'function': {'name': 'odd', 'parameters': {'pattern': '('}}}])}</tools>"
    odd = block("tool_call", id="4", name="odd", arguments="x") + block("tool_result", id="4")
    rows = [(c, 0, "system" if c != 2 else "user", f"be good {tools}") for c in (1, 2)] + [(c, 1, "a", good + bad + other + odd + done) for c in (1, 2, 3)] + [(4, 0, "system", "<tools>[1]</tools><tools>no</tools>"), (None, 0, "a", good)]
    out = chat.linked(spark.createDataFrame(rows, TURNS)).collect()
    error = {(r["conv_id"], r["call_id"]): r["error"] for r in out if r["kind"] == "tool_call"}
    assert [error[1, k] for k in "1234"] == [None, "$.b: missing", "unknown tool", "bad schema"]
    assert [error[c, k] for c in (2, 3) for k in "1234"] == [None] * 8  # a user declares no tools
    assert sorted((r["conv_id"], r["error"]) for r in out if r["kind"] == "tools") == [(1, None), (4, "no tools"), (4, "not JSON")]
    given = {(r["conv_id"], r["call_id"]): r["error"] for r in chat.linked(spark.createDataFrame(rows, TURNS), SCHEMAS).collect() if r["kind"] == "tool_call"}
    assert [given[3, k] for k in "123"] == [None, "$.b: missing", "unknown tool"] and given[None, "1"] == "no result"


@pytest.mark.parametrize("n", [6, 90])
def test_chain_in_few_rounds(spark, monkeypatch, n):
    rows = [(1, n - k, "a", block("tool_call", id=f"n{k}", name="add", arguments={"a": f"$n{k - 1}" if k else 1, "b": 1})) for k in range(n)]
    written, plain = [], chat.checkpointed
    monkeypatch.setattr(chat, "checkpointed", lambda df: written.append(1) or plain(df))
    out = chat.linked(spark.createDataFrame(rows, TURNS), SCHEMAS).collect()
    order = [r["call_id"] for r in sorted(out, key=lambda r: (r["order_turn"], r["order_part"], r["order_level"]))]
    assert order == [f"n{k}" for k in range(n)] and {r["error"] for r in out} == {"no result"}
    assert len(written) <= 3 + 3 * (n.bit_length() + 1)


def plain_keys(calls):
    """calls: id -> (own, ids that it names). The key of each, or None on a cycle or after one."""
    known: dict = {}
    while True:
        ready = {c: max([(*own, 0), *((t, p, far + 1) for t, p, far in (known[r] for r in refs))]) for c, (own, refs) in calls.items() if c not in known and all(r in known for r in refs)}
        if not ready:
            return {c: known.get(c) for c in calls}
        known |= ready


def test_linking_against_brute_force(spark):
    rng = random.Random(12)
    rows, want = [], {}
    for conv in range(25):
        n = rng.choice([3, 8, 14])
        names = [f"c{k}" for k in range(n)]
        calls, results, turn = {}, {}, 0
        for k in rng.sample(range(n), n):
            text = f" note {turn} " if rng.random() < 0.3 else ""
            first = 1 if text else 0
            back = names[:k] if conv % 5 else names  # every fifth may have cycles
            refs = rng.sample(back, min(len(back), rng.choice([0, 1, 1, 2, 3])))
            args = {"a": [({"$ref": r} if rng.random() < 0.5 else f"${r}") for r in refs], "b": "$none"}
            text += block("tool_call", name="f", id=names[k], arguments=args)
            calls[names[k]] = ((turn, first), refs)
            if rng.random() < 0.8:
                text += block("tool_result", id=names[k], content=turn)
                results[names[k]] = (turn, first + 1)
            rows.append((conv, turn, "a", text, "x", 1))
            turn += rng.choice([1, 1, 2])
        for c, key in plain_keys(calls).items():
            error = "cyclic reference" if key is None else None if c in results else "no result"
            want[conv, c, "tool_call"] = (key or (*calls[c][0], 0), c in results, error)
            if c in results:
                t, p, far = key or (*calls[c][0], 0)
                want[conv, c, "tool_result"] = (max((*results[c], 0), (t, p, far + 1)), True, None)
    turns = spark.createDataFrame(rows, TURNS + ", own string, known int").repartition(5)
    out = chat.linked(turns).collect()
    got = {(r["conv_id"], r["call_id"], r["kind"]): ((r["order_turn"], r["order_part"], r["order_level"]), r["linked"], r["error"]) for r in out if r["call_id"]}
    assert got == want
    assert sum(r["kind"] == "message" for r in out) == sum("note" in r[3] for r in rows)


def test_edges(spark):
    """Very long texts, lone surrogates, numbers without end, repeated rows, nulls in any column, clashing names."""
    same = (1, 0, "a", block("tool_call", id="s", name="f", arguments={}) + "é" * 100_000 + "<tool_call>")
    deep = "<tool_call>" + "[" * 30_000 + "]" * 30_000 + "</tool_call>"
    rows = [same, same, (1, 1, None, block("tool_result", id="s")), (None, None, None, None), (2, None, "a", '<tool_call>{"id":"\\ud800","name":"f"}</tool_call><tool_call>{"id":"k","arguments":{"n":1e999}}</tool_call>'), (2, 3, "a", '<tool_call>{"id":"h","name":"\\udfff","arguments":{"x":' + "9" * 400 + "}}</tool_call>"), (3, 0, "a", deep), (4, 0, "a", "<tool_call>{}</tool_call>" * 3000)]
    turns = spark.createDataFrame([(*r, "z", "z", "z") for r in rows], TURNS + ", key string, ref string, name string")
    out = chat.linked(turns, {"f": {"properties": {"x": {"type": "integer", "maximum": 5}}}}).collect()
    assert len(out) == 2 + 2 + 1 + 1 + 2 + 1 + 1 + 3000
    of = lambda c: [r["error"] for r in out if r["conv_id"] == c and r["kind"] == "tool_call"]
    assert of(1) == [None, None] and sorted(of(2)) == ["no id", "not JSON", "unknown tool"] and of(3) == ["not JSON"] and set(of(4)) == {"no id"}
    assert sum(r["linked"] for r in out) == 3
    for r in out:
        json.loads(r["json"])
