"""Linking, order, validation and canonical JSON on fixtures, and the order against brute force."""

import hashlib
import json
from random import Random

from corvana.llm import chat as c

SCHEMAS = {
    "search": {"type": "object", "properties": {"query": {"type": "string"}, "limit": {"type": "integer", "minimum": 1, "maximum": 9}}, "required": ["query"], "additionalProperties": False},
    "sum": {"type": "object", "properties": {"values": {"type": "array", "items": {"type": "number"}}}, "required": ["values"]},
}
NAMES = "conv_id long, turn long, role string, text string, position string"


def call(i, name, arguments, **more):
    return {"id": i, "name": name, "arguments": arguments, **more}


def test_faults():
    rule = SCHEMAS["search"]
    assert c.fault({"query": "x", "limit": 3}, rule) is None
    assert c.fault({"limit": 3}, rule) == "$.query: missing"
    assert c.fault({"query": 1}, rule) == "$.query: not of type string"
    assert c.fault({"query": "x", "limit": 10}, rule) == "$.limit: above maximum"
    assert c.fault({"query": "x", "other": 1}, rule) == "$.other: not allowed"
    assert c.fault({"values": [1, "2"]}, SCHEMAS["sum"]) == "$.values[1]: not of type number"
    assert c.fault(True, {"type": "integer"}) is not None
    assert c.canonical({"b": [1.0, "é"], "a": None}) == '{"a":null,"b":[1.0,"é"]}'


def test_links_and_order(spark):
    rows = [
        (1, 0, "user", "hi", "p"),
        (1, 1, "tool", json.dumps({"tool_call_id": "a", "content": {"z": 1, "a": 2}}), "p"),
        (1, 2, "assistant", json.dumps({"tool_calls": [call("a", "search", {"query": "x"}), call("b", "sum", '{"values": [1, 2]}', after=["a"])]}), "p"),
        (1, 3, "tool", json.dumps({"tool_call_id": "b", "content": 3}), "p"),
        (1, 4, "tool", json.dumps({"tool_call_id": "nobody", "content": 3}), "p"),
        (2, 0, "assistant", json.dumps({"tool_calls": [call("p", "none", {}, after=["q"]), call("q", "sum", {}, after=["p"])]}), "p"),
        (3, 0, "assistant", "{not json", "p"), (3, 1, "user", json.dumps({"tool_calls": []}), "p"), (3, None, None, None, None), (None, 0, "user", "", None),
        (4, 0, "user", "same", "p"), (4, 0, "user", "same", "p"),
    ]
    got = c.chat(spark.createDataFrame(rows, NAMES), SCHEMAS).orderBy("conv_id", "position").collect()
    one = [(r.kind, r.call_id, r.linked, r.valid) for r in got if r.conv_id == 1]
    assert one == [("message", None, None, None), ("call", "a", True, True), ("result", "a", True, None), ("call", "b", True, True), ("result", "b", True, None), ("result", "nobody", False, None)]
    assert [r.line for r in got if r.conv_id == 1][2] == '{"content":{"a":2,"z":1},"role":"tool","tool_call_id":"a"}'
    two = [(r.call_id, r.valid, r.error) for r in got if r.conv_id == 2]
    assert two == [("p", False, "unknown tool none"), ("q", False, "$.values: missing")]
    three = [(r.position, r.kind, r.line) for r in got if r.conv_id == 3]
    assert three == [(0, "message", '{"content":"{not json","role":"assistant"}'), (1, "message", '{"content":"{\\"tool_calls\\": []}","role":"user"}'), (2, "message", '{"content":null,"role":null}')]
    assert [r.position for r in got if r.conv_id == 4] == [0, 1]
    assert [r.position for r in got if r.conv_id is None] == [0]


def test_long_conversation_is_cut_by_ranges(spark):
    rows = [(1, n, "user", f"t{n}", None) for n in range(3000)] + [(1, 5000, "user", f"x{n % 40}", None) for n in range(1500)]
    got = c.chat(spark.createDataFrame(rows, NAMES).repartition(6), SCHEMAS).orderBy("position").collect()
    assert [r.position for r in got] == list(range(4500))
    assert [r.turn for r in got] == sorted(r.turn for r in got)


def test_empty(spark):
    assert c.chat(spark.createDataFrame([], NAMES), SCHEMAS).count() == 0


def test_null_turns_come_last(spark):
    rows = [
        (1, None, "assistant", json.dumps({"tool_calls": [call("a", "search", {"query": "x"})]}), "p"), (1, 5, "tool", json.dumps({"tool_call_id": "a", "content": 1}), "p"), (1, 6, "user", "bye", "p"),
        (2, None, "assistant", json.dumps({"tool_calls": [call("b", "search", {"query": "late"})]}), "p"), (2, 1, "assistant", json.dumps({"tool_calls": [call("b", "search", {"query": "first"})]}), "p"),
        (2, 2, "tool", json.dumps({"tool_call_id": "b", "content": 1}), "p"), (2, 3, "user", "bye", "p"),
    ]
    got = c.chat(spark.createDataFrame(rows, NAMES), SCHEMAS).orderBy("conv_id", "position").collect()
    assert [r.kind for r in got if r.conv_id == 1] == ["message", "call", "result"]
    assert [(r.kind, r.linked, r.turn) for r in got if r.conv_id == 2] == [("call", True, 1), ("result", True, 2), ("message", None, 3), ("call", False, None)]


def brute_order(rows):
    """Keys of a conversation's tool events in order, by repeated passes over plain lists."""
    events = []
    for turn, role, text in set(rows):
        h = hashlib.md5(f"{role}\n{text}".encode()).hexdigest()
        for seq, e in enumerate(c.events_of(role, text, SCHEMAS)):
            events.append(e | {"at": c.LAST if turn is None else turn, "h": h, "seq": seq})
    events.sort(key=lambda e: (e["at"], e["h"], e["seq"]))
    first = {}
    for e in events:
        if e["kind"] == "call" and e["call_id"] is not None:
            first.setdefault(e["call_id"], e)
    answers = {i: [e for e in events if e["kind"] == "result" and e["call_id"] == i] for i in first}
    needs = []
    for e in events:
        own = [first[e["call_id"]]] if e["kind"] == "result" and e["call_id"] in first else []
        own += [x for i in e["after"] if i in first for x in answers[i] or [first[i]]]
        needs.append([x for x in own if x is not e])
    place = {}
    for _ in events:
        for e, own in zip(events, needs, strict=True):
            if id(e) not in place and all(id(x) in place for x in own):
                place[id(e)] = max([(e["at"], 0), *[(place[id(x)][0], place[id(x)][1] + 1) for x in own]])
    order = sorted(events, key=lambda e: (*place.get(id(e), (e["at"], 0)), e["at"], e["h"], e["seq"]))
    return [(e["line"], e["error"] or (None if id(e) in place else "cycle")) for e in order]


def test_order_by_brute_force(spark):
    random, rows = Random(7), []
    for conv in range(40):
        ids = [f"c{n}" for n in range(random.randint(1, 8))]
        for _ in range(random.randint(1, 14)):
            turn = random.choice([None, *range(6)])
            if random.random() < 0.5:
                text = json.dumps({"tool_call_id": random.choice(ids), "content": random.randint(0, 3)})
                rows.append((conv, turn, "tool", text, None))
            else:
                calls = [call(random.choice(ids), "sum", {"values": [random.randint(0, 9)]}, after=random.sample(ids, random.randint(0, min(2, len(ids))))) for _ in range(random.randint(1, 2))]
                rows.append((conv, turn, "assistant", json.dumps({"tool_calls": calls}), None))
    rows = list(dict.fromkeys(rows))
    got = c.chat(spark.createDataFrame(rows, NAMES).repartition(5), SCHEMAS, part_rows=20).orderBy("conv_id", "position").collect()
    for conv in range(40):
        want = brute_order([r[1:4] for r in rows if r[0] == conv])
        assert [(r.line, r.error) for r in got if r.conv_id == conv] == want


def test_long_chain(spark):
    rows = []
    for n in range(1000):  # each call needs the one before; turns run against the chain
        rows.append((1, 2000 - n, "assistant", json.dumps({"tool_calls": [call(f"c{n}", "sum", {"values": [n]}, after=[f"c{n - 1}"] if n else [])]}), None))
    got = c.chat(spark.createDataFrame(rows, NAMES).repartition(3), SCHEMAS).orderBy("position").collect()
    assert [r.call_id for r in got] == [f"c{n}" for n in range(1000)]
    split = c.chat(spark.createDataFrame(rows[:60], NAMES), SCHEMAS, part_rows=20).orderBy("position").collect()
    assert [r.call_id for r in split] == [f"c{n}" for n in range(60)]
