"""Chat formatting with linked tool calls.

An assistant turn whose text is a JSON object with "tool_calls" holds calls ({"id", "name",
"arguments"}); a turn of role tool holds a result ({"tool_call_id", "content"}). Calls and results
are joined by hash on conversation and identifier. An argument {"$ref": id} makes a call depend on
another of its conversation; calls get the level of the longest chain of references below them,
found by joins between stretches of `TURNS` turns, whatever the chain's length, and in memory
within them. Arguments are validated against the tool's JSON schema, and every message, call and
result is one row of canonical JSON (sorted keys, no blanks, UTF-8). Rows, not conversations, are
the unit: of a conversation, one task holds the references of `TURNS` turns at most.
Ordered by conv_id, turn, part, level, position they read as the conversation; calls come
in topological order.

Defined results: a null text is an empty message, a null role "user"; text that is no such JSON is a
plain message; several calls with one identifier: the first by turn and position is the call,
others are marked duplicate; likewise results; calls without result and results without call are
marked unlinked; references to unknown calls, to later turns or in a circle give level null and
status "cyclic"; a call without a known schema has valid null. Rows without conv_id are formatted
and never linked. Repeated rows are formatted each: the first of equal calls by turn and position is
the call (a null turn comes before all others), and so is every exact repeat of its row. JSON that
Python reads but no standard allows (NaN, infinities) and JSON nested deeper than `DEEPEST` is no
JSON: the turn is a plain message, arguments sent as such a string stay a string. Code points that
UTF-8 cannot carry (lone surrogates) become U+FFFD everywhere. An empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm.common import checkpointed

#: Schemas of the tools that are known when none are given.
TOOLS: Mapping[str, dict] = {
    "search": {"type": "object", "properties": {"query": {"type": "string", "minLength": 1}, "limit": {"type": "integer", "minimum": 1, "maximum": 100}}, "required": ["query"], "additionalProperties": False},
    "calculate": {"type": "object", "properties": {"expression": {"type": "string"}}, "required": ["expression"]},
    "fetch": {"type": "object", "properties": {"url": {"type": "string", "pattern": "^https?://"}, "headers": {"type": "object"}}, "required": ["url"]},
}

DEEPEST = 100  # levels of nested objects and arrays
TURNS = 1024  # turns of a conversation whose calls are ordered together

_TYPES = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "object": dict, "array": list, "null": type(None)}


def errors(value, schema: dict, at: str = "$") -> list[str]:
    """What in value breaks the schema: the common keywords of JSON schema."""
    if isinstance(value, dict) and set(value) == {"$ref"} and at != "$":
        return []  # stands for another call's result
    found, kinds = [], schema.get("type")
    kinds = [kinds] if isinstance(kinds, str) else kinds or []
    if kinds and not any(isinstance(value, _TYPES.get(k, ())) and not (isinstance(value, bool) and k in ("integer", "number")) for k in kinds):
        return [f"{at}: not of type {'/'.join(kinds)}"]
    if "enum" in schema and value not in schema["enum"]:
        found.append(f"{at}: not one of the values")
    if isinstance(value, str):
        if len(value) < schema.get("minLength", 0) or len(value) > schema.get("maxLength", len(value)):
            found.append(f"{at}: length")
        if "pattern" in schema and not re.search(schema["pattern"], value):
            found.append(f"{at}: pattern")
    if isinstance(value, int | float) and not isinstance(value, bool) and not schema.get("minimum", value) <= value <= schema.get("maximum", value):
        found.append(f"{at}: out of range")
    if isinstance(value, dict):
        own = schema.get("properties", {})
        found += [f"{at}.{k}: missing" for k in schema.get("required", []) if k not in value]
        for k, v in value.items():
            if k in own:
                found += errors(v, own[k], f"{at}.{k}")
            elif schema.get("additionalProperties") is False:
                found.append(f"{at}.{k}: unknown")
    if isinstance(value, list):
        found += [e for i, v in enumerate(value) if "items" in schema for e in errors(v, schema["items"], f"{at}[{i}]")]
    return found


def canonical(value) -> str:
    return whole(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False))


def whole(text: str) -> str:
    """The text with U+FFFD for what UTF-8 cannot carry."""
    return re.sub("[\ud800-\udfff]", "\ufffd", text)


def deep(value) -> bool:
    """Whether objects and arrays are nested deeper than DEEPEST."""
    level = [value]
    for _ in range(DEEPEST + 1):
        level = [x for v in level for x in (v.values() if isinstance(v, dict) else v if isinstance(v, list) else ())]
        if not level:
            return False
    return True


def refuse(name: str):
    raise ValueError(name)


def loaded(text: str):
    """The JSON value of a text; ValueError if it is none that can be written again."""
    try:
        value = json.loads(text, parse_constant=refuse, parse_float=finite)
    except RecursionError:
        raise ValueError("too deep") from None
    if deep(value):
        raise ValueError("too deep")
    return value


def finite(digits: str) -> float:
    value = float(digits)
    return value if math.isfinite(value) else refuse(digits)


def references(value) -> set[str]:
    if isinstance(value, dict):
        if set(value) == {"$ref"} and isinstance(value["$ref"], str):
            return {value["$ref"]}
        return set().union(*map(references, value.values())) if value else set()
    return set().union(*map(references, value)) if isinstance(value, list) and value else set()


def parsed(text: str) -> dict | None:
    if not text.lstrip().startswith("{"):
        return None
    try:
        value = loaded(text)
    except ValueError:
        return None
    return value if isinstance(value, dict) else None


PARTS = "conv_id long, turn long, kind string, part int, position int, call_id string, refs array<string>, valid boolean, problems string, json string"
_ARROW = [pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.list_(pa.string()), pa.bool_(), pa.string(), pa.string()]


def named(identifier) -> str | None:
    """An identifier as text; numbers, objects and the like by their canonical JSON."""
    return None if identifier is None else whole(identifier) if isinstance(identifier, str) else canonical(identifier)


def parts_of(conv, turn, role: str | None, text: str | None, tools: Mapping[str, dict]) -> Iterator[tuple]:
    """Rows of one turn: its message, its calls, or its result."""
    role, text = role or "user", text or ""
    value = parsed(text) if role in ("assistant", "tool") else None
    if role == "assistant" and value is not None and isinstance(value.get("tool_calls"), list):
        said = value.get("content")
        yield conv, turn, "message", 0, 0, None, [], None, None, canonical({"role": role, "content": said if isinstance(said, str) else ""})
        for i, call in enumerate(value["tool_calls"]):
            call = call if isinstance(call, dict) else {}
            given = call.get("arguments", {})
            if isinstance(given, str):  # arguments are often sent as a JSON string
                try:
                    given = loaded(given)
                except ValueError:
                    pass
            schema, name = tools.get(str(call.get("name"))), call.get("name")
            wrong = errors(given, schema) if schema is not None else ["no schema"]
            yield conv, turn, "call", 1, i, named(call.get("id")), sorted(map(whole, references(given))), None if schema is None else not wrong, whole("; ".join(wrong)) or None, canonical({"arguments": given, "id": call.get("id"), "name": name})
    elif role == "tool" and value is not None and "tool_call_id" in value:
        yield conv, turn, "result", 2, 0, named(value["tool_call_id"]), [], None, None, canonical({"role": role, "tool_call_id": value["tool_call_id"], "content": value.get("content")})
    else:
        yield conv, turn, "message", 0, 0, None, [], None, None, canonical({"role": role, "content": text})


def parts(conversations: DataFrame, tools: Mapping[str, dict] = TOOLS) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [p for r in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text")), strict=True) for p in parts_of(*r, tools)]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(_ARROW)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _ARROW, strict=True)], [x.split(" ")[0] for x in PARTS.split(", ")])

    slim = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    return slim.mapInArrow(run, PARTS)


def ordered(group: pa.Table) -> pa.Table:
    """conv_id, call_id, turn, level of the calls of a group that need only calls of known level and each other."""
    turn, missing, top, users = {}, {}, {}, {}
    for call, t, ref, level in zip(*(group.column(c).to_pylist() for c in ("call_id", "turn", "ref", "level")), strict=True):
        turn[call] = t
        missing[call] = missing.get(call, 0) + (level is None)
        top[call] = max(top.get(call, -1), -1 if level is None else level)
        if level is None:
            users.setdefault(ref, []).append(call)
    done = [c for c, n in missing.items() if not n]
    for c in done:  # grows
        for u in users.get(c, ()):
            if turn[c] is not None and turn[u] is not None and turn[c] <= turn[u]:
                missing[u] -= 1
                top[u] = max(top[u], top[c] + 1)
                if not missing[u]:
                    done.append(u)
    conv = group.column("conv_id")[0].as_py()
    columns = ([conv] * len(done), done, [turn[c] for c in done], [top[c] + 1 for c in done])
    return pa.table({n: pa.array(v, t) for (n, t), v in zip(_LEVELS, columns, strict=True)})


_LEVELS = (("conv_id", pa.int64()), ("call_id", pa.string()), ("turn", pa.int64()), ("level", pa.int32()))


def levelled(calls: DataFrame, turns: int = TURNS) -> DataFrame:
    """conv_id, call_id, level of the calls (conv_id, call_id, turn, refs) whose references can be ordered.

    A round joins the levels that the last one found to the references, and orders what then can be among the calls
    of each `turns` turns of a conversation; a chain takes a round each time it leaves such a stretch."""
    edges = calls.select("conv_id", "call_id", "turn", F.explode("refs").alias("ref"), F.lit(None).cast("int").alias("level"))
    edges = checkpointed(edges)
    known = calls.where(F.size("refs") == 0).select("conv_id", "call_id", "turn", F.lit(0).alias("level"))
    if edges.isEmpty():
        return known.drop("turn")
    known = new = checkpointed(known)
    while True:  # a round without new levels is the last
        # References to calls in their own turn or before count.
        below = new.select("conv_id", F.col("call_id").alias("ref"), F.col("turn").alias("at"), F.col("level").alias("found"))
        met = F.coalesce("level", F.when(F.col("at") <= F.col("turn"), F.col("found")))
        edges = checkpointed(edges.join(below, ["conv_id", "ref"], "left").select("conv_id", "call_id", "turn", "ref", met.alias("level")))
        new = checkpointed(edges.groupBy("conv_id", F.expr(f"turn div {turns}")).applyInArrow(ordered, "conv_id long, call_id string, turn long, level int"))
        if new.isEmpty():
            return known.drop("turn")
        edges = edges.join(new.select("conv_id", "call_id"), ["conv_id", "call_id"], "left_anti")
        known = checkpointed(known.unionByName(new))


def formatted(conversations: DataFrame, tools: Mapping[str, dict] = TOOLS) -> DataFrame:
    """One row per message, call and result: conv_id, turn, part, level, position, kind, call_id, status, valid, problems, json."""
    rows = parts(conversations, tools)
    named = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    linked = checkpointed(rows.where((F.col("kind") != "message") & named))
    place = F.struct("turn", "position", F.xxhash64("json"))
    heads = linked.groupBy("conv_id", "call_id", "kind").agg(F.min(F.struct("turn", "position", F.xxhash64("json").alias("h"), "refs")).alias("head"), F.min(place).alias("place"), F.count("*").alias("times"))
    first = heads.where("kind = 'call'")
    levels = levelled(first.select("conv_id", "call_id", F.col("head.turn").alias("turn"), F.col("head.refs").alias("refs")))
    answered = heads.where("kind = 'result'").select("conv_id", "call_id", F.col("head.turn").alias("result_turn"), F.col("head.h").alias("result_hash"))
    calls = first.select("conv_id", "call_id", F.col("head.turn").alias("call_turn"), F.col("head.position").alias("call_position"), F.col("head.h").alias("call_hash"))
    known = calls.join(answered, ["conv_id", "call_id"], "full").join(levels, ["conv_id", "call_id"], "left")
    keyed = linked.join(known, ["conv_id", "call_id"])
    own = F.xxhash64("json")
    is_first = F.when(F.col("kind") == "call", F.col("turn").eqNullSafe(F.col("call_turn")) & (F.col("position") == F.col("call_position")) & (own == F.col("call_hash"))).otherwise(F.col("turn").eqNullSafe(F.col("result_turn")) & (own == F.col("result_hash")))
    matched = F.col("call_turn").isNotNull() & F.col("result_turn").isNotNull() & (F.col("result_turn") >= F.col("call_turn"))
    status = F.when(~F.coalesce(is_first, F.lit(False)), "duplicate").when((F.col("kind") == "call") & F.col("level").isNull(), "cyclic").when(F.coalesce(matched, F.lit(False)), "linked").otherwise("unlinked")
    shown = ("conv_id", "turn", "part", "level", "position", "kind", "call_id", "status", "valid", "problems", "json")
    done = keyed.withColumn("status", status).select(*shown)
    plain = rows.where((F.col("kind") == "message") | ~named).withColumns({"level": F.lit(None).cast("int"), "status": F.when(F.col("kind") == "message", "message").otherwise("unlinked")}).select(*shown)
    return plain.unionByName(done)
