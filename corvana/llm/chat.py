"""Chat formatting with tool-call linking.

Each message becomes events: a plain message, a tool call for each entry of an assistant's
``{"tool_calls": [{"id", "name", "arguments", "after"?}], "content"?}``, or a tool result
``{"tool_call_id", "content"}``. Calls and results of a conversation are joined by identifier; every
event is placed after what it needs (a result after its call, a call after the results of the calls
in its ``after``); arguments are checked against the tool's schema; each event is written as
canonical JSON: sorted keys, no blanks, numbers and strings in their shortest form.

Positions come from one global range sort, whose ranges cut through long conversations: a row's
position is its rank within its range and conversation plus the counts of the ranges before.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvana.llm.batches import mapper
from corvana.session import cut

#: The turn of a message without one: after all others.
LAST = (1 << 63) - 1
#: Needs that are followed together in one task.
PART_ROWS = 200_000

TYPES = {
    "object": lambda v: isinstance(v, dict), "array": lambda v: isinstance(v, list), "string": lambda v: isinstance(v, str),
    "integer": lambda v: isinstance(v, int) and not isinstance(v, bool) or isinstance(v, float) and v.is_integer(),
    "number": lambda v: isinstance(v, int | float) and not isinstance(v, bool), "boolean": lambda v: isinstance(v, bool), "null": lambda v: v is None,
}


def canonical(value) -> str:
    """Canonical JSON; NaN and infinities are refused."""
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"), allow_nan=False)


def fault(value, schema: dict, at: str = "$") -> str | None:
    """The first breach of a schema (type, enum, const, properties, required, additionalProperties, items, minimum, maximum), or None."""
    kinds = schema.get("type")
    if kinds is not None:
        kinds = [kinds] if isinstance(kinds, str) else kinds
        if not any(TYPES[k](value) for k in kinds):
            return f"{at}: not of type {'/'.join(kinds)}"
    if "enum" in schema and value not in schema["enum"]:
        return f"{at}: not in enum"
    if "const" in schema and value != schema["const"]:
        return f"{at}: not the constant"
    if TYPES["number"](value):
        if "minimum" in schema and value < schema["minimum"]:
            return f"{at}: below minimum"
        if "maximum" in schema and value > schema["maximum"]:
            return f"{at}: above maximum"
    if isinstance(value, dict):
        own = schema.get("properties", {})
        for name in schema.get("required", []):
            if name not in value:
                return f"{at}.{name}: missing"
        for name in sorted(value):
            rule = own.get(name, schema.get("additionalProperties", True))
            if rule is False:
                return f"{at}.{name}: not allowed"
            if isinstance(rule, dict) and (found := fault(value[name], rule, f"{at}.{name}")):
                return found
    if isinstance(value, list) and isinstance(schema.get("items"), dict):
        for n, item in enumerate(value):
            if found := fault(item, schema["items"], f"{at}[{n}]"):
                return found
    return None


def loaded(text: str | None) -> dict | None:
    if not text or not text.lstrip().startswith("{"):
        return None
    try:
        value = json.loads(text)
        canonical(value)
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def call_event(call: dict, schemas: dict[str, dict]) -> dict:
    arguments, error = call.get("arguments", {}), None
    if isinstance(arguments, str):
        arguments, given = loaded(arguments), arguments
        if arguments is None:
            arguments, error = given, "$: not a JSON object"
    name = call.get("name")
    if error is None:
        error = fault(arguments, schemas[name]) if name in schemas else f"unknown tool {name}"
    after = call.get("after") or []
    line = canonical({"arguments": arguments, "id": call.get("id"), "name": name, "role": "assistant", "type": "tool_call"})
    call_id = call.get("id")
    return {"kind": "call", "call_id": None if call_id is None else str(call_id), "error": error, "after": [str(a) for a in after] if isinstance(after, list) else [], "line": line}


def events_of(role: str | None, text: str | None, schemas: dict[str, dict]) -> list[dict]:
    """The events of one message, in order."""
    plain = {"kind": "message", "call_id": None, "error": None, "after": [], "line": canonical({"content": text, "role": role})}
    value = loaded(text) if role in ("assistant", "tool") else None
    if value is None:
        return [plain]
    if role == "tool" and "tool_call_id" in value:
        call_id = value["tool_call_id"]
        line = canonical({"content": value.get("content"), "role": role, "tool_call_id": call_id})
        return [plain | {"kind": "result", "call_id": None if call_id is None else str(call_id), "line": line}]
    calls = value.get("tool_calls")
    if role != "assistant" or not isinstance(calls, list) or not all(isinstance(c, dict) for c in calls):
        return [plain]
    content = value.get("content")
    head = [plain | {"line": canonical({"content": content, "role": role})}] if content is not None or not calls else []
    return head + [call_event(c, schemas) for c in calls]


EVENT = pa.schema([
    ("conv", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("h", pa.string()), ("seq", pa.int32()), ("kind", pa.string()),
    ("call_id", pa.string()), ("error", pa.string()), ("after", pa.list_(pa.string())), ("line", pa.string()),
])
EVENT_DDL = "conv long, turn long, role string, h string, seq int, kind string, call_id string, error string, after array<string>, line string"


def event_rows(df: DataFrame, schemas: dict[str, dict], conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for conv, turn, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv", "turn", "role", "t")), strict=True):
            h = hashlib.md5(f"{role or ''}\n{text or ''}".encode("utf-8", "surrogatepass")).hexdigest()
            out += [{"conv": conv, "turn": turn, "role": role, "h": h, "seq": n} | e for n, e in enumerate(events_of(role, text, schemas))]
        return pa.RecordBatch.from_pylist(out, schema=EVENT)

    rows = df.select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("t"))
    return rows.mapInArrow(mapper(kernel, "t"), EVENT_DDL)


def linked(tools: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv, call_id, call, result) uids of the calls that results belong to; and the edges (before, after) of what must follow what."""
    calls = tools.where("kind = 'call' and call_id is not null").groupBy("conv", "call_id").agg(F.min_by("uid", F.struct("at", "h", "seq")).alias("call"))
    results = tools.where("kind = 'result' and call_id is not null").select("conv", "call_id", F.col("uid").alias("result")).distinct()
    links = calls.alias("c").join(results.alias("r"), F.col("c.conv").eqNullSafe(F.col("r.conv")) & (F.col("c.call_id") == F.col("r.call_id")), "left")
    links = cut(links.select("c.conv", "c.call_id", "call", "result"))
    wants = tools.where("kind = 'call'").select("conv", F.col("uid").alias("after"), F.explode("after").alias("call_id")).alias("w")
    needed = wants.join(links.alias("l"), F.col("w.conv").eqNullSafe(F.col("l.conv")) & (F.col("w.call_id") == F.col("l.call_id")))
    edges = links.where("result is not null").select(F.col("call").alias("before"), F.col("result").alias("after"))
    edges = edges.union(needed.select(F.coalesce("result", "call").alias("before"), "after")).where("before <> after").distinct()
    return links, cut(edges)


PLACE = pa.schema([("uid", pa.string()), ("eff", pa.int64()), ("depth", pa.int32())])


def placed_after(at: dict[str, int], needs: dict[str, list[str]], known: dict[str, tuple[int, int]]) -> dict[str, tuple[int, int]]:
    """(eff, depth) of the events all of whose needs are known or follow from known ones, in topological order."""
    missing = {uid: sum(b not in known for b in own) for uid, own in needs.items()}
    waiting: dict[str, list[str]] = {}
    for uid, own in needs.items():
        for b in own:
            if b not in known:
                waiting.setdefault(b, []).append(uid)
    found, ready = {}, [uid for uid, n in missing.items() if not n]
    while ready:
        uid = ready.pop()
        eff, depth = max(found.get(b) or known[b] for b in needs[uid])
        found[uid] = max((at[uid], 0), (eff, depth + 1))
        for other in waiting.get(uid, ()):
            missing[other] -= 1
            if not missing[other]:
                ready.append(other)
    return found


def resolved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places of the events of each part that its rows (part, after, at, before, eff, depth) settle; rows are sorted by part."""
    part, at, needs, known = None, {}, {}, {}

    def out() -> pa.RecordBatch:
        found = placed_after(at, needs, known)
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip((found, [x[0] for x in found.values()], [x[1] for x in found.values()]), PLACE.types, strict=True)], schema=PLACE)

    for batch in batches:
        for p, after, turn, before, eff, depth in zip(*(batch.column(c).to_pylist() for c in ("part", "after", "at", "before", "eff", "depth")), strict=True):
            if p != part:
                yield out()
                part, at, needs, known = p, {}, {}, {}
            at[after] = turn
            needs.setdefault(after, []).append(before)
            if eff is not None:
                known[before] = (eff, depth)
    yield out()


def ordered(tools: DataFrame, edges: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """(uid, eff, depth, cyclic): each event's turn after moving it behind what it needs.

    The needs are dealt into parts of about part_rows by conversation and turn, and each round every
    part follows its chains as far as they lead; another round is due only where a chain has crossed
    from one part to another. Events on or behind a cycle keep their turn.
    """
    nodes = tools.select("uid", "conv", "at").dropDuplicates(["uid"])
    needing = edges.join(nodes.withColumnRenamed("uid", "after"), "after")
    known = cut(nodes.join(edges.select(F.col("after").alias("uid")).distinct(), "uid", "left_anti").select("uid", F.col("at").alias("eff"), F.lit(0).alias("depth")))
    parts = max(1, -(-edges.count() // part_rows))
    pending = cut(needing.repartitionByRange(parts, "conv", "at", "after").select("after", "at", "before", F.spark_partition_id().alias("part")))
    while True:
        rows = pending.join(known.withColumnRenamed("uid", "before"), "before", "left")
        new = cut(rows.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(resolved, "uid string, eff long, depth int"))
        if new.isEmpty():
            break
        known = cut(known.union(new))
        pending = cut(pending.join(new.select(F.col("uid").alias("after")), "after", "left_anti"))
        if pending.isEmpty():
            break
    rest = nodes.join(known, "uid", "left_anti").select("uid", F.col("at").alias("eff"), F.lit(0).alias("depth"), F.lit(True).alias("cyclic"))
    return known.withColumn("cyclic", F.lit(False)).union(rest)


def chat(df: DataFrame, schemas: dict[str, dict], conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", part_rows: int = PART_ROWS) -> DataFrame:
    """(conv_col, position, turn_col, role, kind, call_id, linked, valid, error, line): a row for each event of each message.

    position counts from 0 in each conversation. linked: whether a call has a result, or a result a
    call; where a call's identifier repeats, its first call in order has the results. valid: whether
    a call's arguments keep the schema of its tool; error says why not (also for unknown tools). Both
    are null where they don't apply. Text that isn't such JSON, also null and empty text, is a plain
    message; texts are written whole, however long. Null conversations form one of their own; null
    turns come last, and so does what needs them; messages of equal turns follow in the order of
    their hash, so repeated rows stand together. Only the four columns are read.
    """
    uid = F.concat_ws(":", F.coalesce(F.col("conv").cast("string"), F.lit("")), F.coalesce(F.col("turn").cast("string"), F.lit("")), "h", "seq")
    events = cut(event_rows(df, schemas, conv_col, turn_col, role_col, text_col))  # parsed once
    events = events.withColumns({"uid": uid, "at": F.coalesce("turn", F.lit(LAST))})
    tools = events.where("kind <> 'message'").select("uid", "conv", "at", "h", "seq", "kind", "call_id", "after")
    if tools.isEmpty():
        events = events.withColumns({"eff": F.col("at"), "depth": F.lit(0), "cyclic": F.lit(False), "partner": F.lit(False)})
    else:
        links, edges = linked(tools)
        places = ordered(tools, edges, part_rows)
        partners = links.where("result is not null").select(F.explode(F.array("call", "result")).alias("uid")).distinct().withColumn("partner", F.lit(True))
        events = events.join(places, "uid", "left").join(partners, "uid", "left").withColumns({"eff": F.coalesce("eff", "at"), "depth": F.coalesce("depth", F.lit(0))})
    keys = [F.asc_nulls_first("conv"), F.asc("eff"), F.asc("depth"), F.asc("at"), F.asc("h"), F.asc("seq")]
    ranged = cut(events.drop("uid", "after").repartitionByRange(*keys).withColumn("pid", F.spark_partition_id()))
    counts = ranged.groupBy("conv", "pid").agg(F.count("*").alias("n"))
    before = counts.select("conv", "pid", F.coalesce(F.sum("n").over(Window.partitionBy("conv").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    local = ranged.withColumn("local", F.row_number().over(Window.partitionBy("conv", "pid").orderBy(*keys[1:])))
    placed = local.alias("e").join(before.alias("b"), F.col("e.conv").eqNullSafe(F.col("b.conv")) & (F.col("e.pid") == F.col("b.pid")))
    is_tool = F.col("kind") != "message"
    return placed.select(
        F.col("e.conv").alias(conv_col), (F.col("start") + F.col("local") - 1).alias("position"), F.col("turn").alias(turn_col), "role", "kind", "call_id",
        F.when(is_tool, F.coalesce("partner", F.lit(False))).alias("linked"), F.when(F.col("kind") == "call", F.col("error").isNull()).alias("valid"),
        F.coalesce("error", F.when(F.col("cyclic"), F.lit("cycle"))).alias("error"), "line",
    )


#: DuckDB SQL for conversations without tool calls, as those of the table are.
ORACLE_SQL = """
SELECT conv_id,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, md5(coalesce(role, '') || chr(10) || coalesce(text, ''))) - 1 AS position,
  turn, role, 'message' AS kind, CAST(NULL AS VARCHAR) AS call_id, CAST(NULL AS BOOLEAN) AS linked, CAST(NULL AS BOOLEAN) AS valid,
  CAST(NULL AS VARCHAR) AS error, CAST(json_object('content', text, 'role', role) AS VARCHAR) AS line
FROM conversations
"""
