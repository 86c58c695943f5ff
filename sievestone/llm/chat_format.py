"""Chat formatting with tool-call linking.

Input: messages (conversation, turn, role, text). An assistant's text may be a JSON object
{"content": ..., "tool_calls": [{"id", "name", "arguments"}, ...]}, where arguments are an
object or its JSON; a tool's text may be {"tool_call_id": ..., "content": ...}. Arguments
refer to an earlier call's result by {"$result": "<id>"}. Anything else is plain text.

Every message is parsed once, its arguments are validated against the tools' schemas and
its canonical JSON (sorted keys, no blanks, UTF-8) is made. Calls and results are then
hash-joined by (conversation, id): of calls of one id the first owns it, of results the
first answers it. Messages keep their turns unless a result stands before its call or a
call before a result it needs: those move behind what they need, in topological order, level
by level. A cycle is cut at its first message, which keeps its own turn and says so.

Output: one row per message, so that a conversation of any length is never one group:
conversation, turn, order_turn, order_level (sort by these two, then turn), role, kind
(text, calls, result, orphan, repeat), n_calls, n_answered, n_invalid, errors, cyclic, json.

Defined results: null text is empty content; a null role is "user"; a null turn sorts
first; a null conversation is one of its own; repeated rows are messages of their own, the
second call or result of an id being a repeat; broken JSON is plain text; a tool without a
schema is an error of its call; an empty table gives an empty table; other columns are
ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import map_rows, materialise

#: Schemas of the production query's tools (the subset of JSON Schema that `violations` knows).
TOOLS: dict[str, dict] = {
    "search": {"type": "object", "properties": {"query": {"type": "string", "minLength": 1}, "limit": {"type": "integer", "minimum": 1}}, "required": ["query"], "additionalProperties": False},
    "calculator": {"type": "object", "properties": {"expression": {"type": "string", "minLength": 1}}, "required": ["expression"], "additionalProperties": False},
}
_TYPES = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "object": dict, "array": list, "null": type(None)}


def canonical(value: Any) -> str:
    return json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":"))


def violations(value: Any, schema: dict, at: str = "$") -> list[str]:
    """How a value fails a schema; references to results pass any type."""
    if isinstance(value, dict) and set(value) == {"$result"}:
        return []
    kind = schema.get("type")
    kinds = [kind] if isinstance(kind, str) else kind or []
    if kinds and not any(isinstance(value, _TYPES[k]) and not (isinstance(value, bool) and k in ("integer", "number")) for k in kinds):
        return [f"{at}: not {'/'.join(kinds)}"]
    out = []
    if "enum" in schema and value not in schema["enum"]:
        out.append(f"{at}: not in enum")
    if isinstance(value, str):
        if len(value) < schema.get("minLength", 0):
            out.append(f"{at}: too short")
        if len(value) > schema.get("maxLength", len(value)):
            out.append(f"{at}: too long")
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        if value < schema.get("minimum", value):
            out.append(f"{at}: too small")
        if value > schema.get("maximum", value):
            out.append(f"{at}: too large")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{at}.{k}: missing" for k in schema.get("required", []) if k not in value]
        for k, v in sorted(value.items()):
            if k in known:
                out += violations(v, known[k], f"{at}.{k}")
            elif schema.get("additionalProperties", True) is False:
                out.append(f"{at}.{k}: unknown")
    if isinstance(value, list) and "items" in schema:
        for i, v in enumerate(value):
            out += violations(v, schema["items"], f"{at}[{i}]")
    return out


def _needs(value: Any) -> set[str]:
    if isinstance(value, dict):
        if set(value) == {"$result"}:
            return {str(value["$result"])}
        return set().union(*map(_needs, value.values())) if value else set()
    return set().union(*map(_needs, value)) if isinstance(value, list) and value else set()


def _object(text: str) -> dict | None:
    if not text.lstrip().startswith("{"):
        return None
    try:
        out = json.loads(text)
    except (ValueError, RecursionError):
        return None
    return out if isinstance(out, dict) else None


def parse(role: str | None, text: str | None, tools: dict[str, dict]) -> dict:
    """A message's kind, canonical JSON, calls (id, error, needs) and the id that it answers."""
    role, text = role or "user", text or ""
    found = _object(text)
    if role == "assistant" and found and isinstance(found.get("tool_calls"), list) and found["tool_calls"] and all(isinstance(c, dict) and c.get("id") is not None and c.get("name") is not None for c in found["tool_calls"]):
        calls, shown = [], []
        for c in found["tool_calls"]:
            given, wrong = c.get("arguments", {}), []
            if isinstance(given, str):
                given = _object(given)
                wrong = [] if given is not None else ["$: not an object"]
            if not wrong:
                wrong = violations(given, tools[str(c["name"])]) if str(c["name"]) in tools else [f"unknown tool {c['name']}"]
            shown.append({"id": str(c["id"]), "type": "function", "function": {"name": str(c["name"]), "arguments": canonical(given)}})
            calls.append({"id": str(c["id"]), "error": "; ".join(wrong) or None, "needs": sorted(_needs(given))})
        message = {"role": role, "content": found.get("content"), "tool_calls": shown}
        return {"kind": "calls", "json": canonical(message), "calls": calls, "answers": None}
    if role == "tool" and found and found.get("tool_call_id") is not None:
        content = found.get("content")
        content = content if isinstance(content, str) else canonical(content)
        return {"kind": "result", "json": canonical({"role": role, "tool_call_id": str(found["tool_call_id"]), "content": content}), "calls": [], "answers": str(found["tool_call_id"])}
    return {"kind": "text", "json": canonical({"role": role, "content": text}), "calls": [], "answers": None}


def _parse_all(tools: dict[str, dict]):
    call = pa.struct([("id", pa.string()), ("error", pa.string()), ("needs", pa.list_(pa.string()))])

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        got = [parse(r, t, tools) for r, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
        return pa.record_batch(
            [*batch.columns[:3], pa.array([x["kind"] for x in got], pa.string()), pa.array([x["json"] for x in got], pa.string()), pa.array([x["calls"] for x in got], pa.list_(call)), pa.array([x["answers"] for x in got], pa.string())],
            ["conv", "turn", "role", "kind", "json", "calls", "answers"],
        )

    return work


def order_rows(edges: list[tuple[int, int, int, int]]) -> dict[int, tuple[int, int, bool]]:
    """Per row of one chat's edges (before, before_turn, after, after_turn): its order turn and level, and whether a cycle was cut there.

    What lies on no cycle and between no two is peeled off from both ends. While rows are
    left, the first of them (by turn, then row) is cut from what it waits for. Then every
    row stands at its own turn, or one level behind the latest row that it waits for.
    """
    turn: dict[int, int] = {}
    ahead: dict[int, set[int]] = {}
    behind: dict[int, set[int]] = {}
    for x, tx, y, ty in edges:
        turn[x], turn[y] = tx, ty
        ahead.setdefault(x, set()).add(y)
        behind.setdefault(y, set()).add(x)
    waits = {r: set(behind.get(r, ())) for r in turn}
    leads = {r: set(ahead.get(r, ())) for r in turn}

    def peel(rows: list[int]) -> None:
        while rows:
            r = rows.pop()
            if r not in waits or waits[r] and leads[r]:
                continue
            for x in waits.pop(r):
                leads[x].discard(r)
                rows.append(x)
            for y in leads.pop(r):
                waits[y].discard(r)
                rows.append(y)

    peel(list(turn))
    cut = set()
    for r in sorted(waits, key=lambda r: (turn[r], r)):
        if r in waits:
            cut.add(r)
            touched = list(waits[r])
            for x in touched:
                leads[x].discard(r)
            waits[r] = set()
            behind[r] = {x for x in behind[r] if x not in touched}
            for x in touched:
                ahead[x].discard(r)
            peel([r, *touched])
    left = {r: len(behind.get(r, ())) for r in turn}
    at, free = {r: (t, 0) for r, t in turn.items()}, [r for r, n in left.items() if not n]
    while free:
        x = free.pop()
        for y in ahead.get(x, ()):
            at[y] = max(at[y], (at[x][0], at[x][1] + 1))
            left[y] -= 1
            if not left[y]:
                free.append(y)
    return {r: (*at[r], r in cut) for r in turn}


def _settle(edges: DataFrame) -> DataFrame:
    """(row, order_turn, order_level, cyclic) of the rows of chats in which some row stands before what it waits for.

    edges: (chat, before, before_turn, after, after_turn). All chats are ordered in one pass;
    a task holds the edges of one chat at a time (links between its calls and results, never
    its messages' texts).
    """
    late = F.max((F.col("before_turn") > F.col("after_turn")) | ((F.col("before_turn") == F.col("after_turn")))).alias("late")
    wrong = edges.groupBy("chat").agg(late).where("late").select("chat")
    mine = edges.join(wrong, "chat", "left_semi").select("chat", "before", "before_turn", "after", "after_turn")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chat, own = None, []

        def done() -> pa.RecordBatch:
            found = order_rows(own)
            return pa.record_batch(
                [pa.array(list(found), pa.int64()), pa.array([v[0] for v in found.values()], pa.int64()), pa.array([v[1] for v in found.values()], pa.int64()), pa.array([v[2] for v in found.values()], pa.bool_())],
                ["row", "order_turn", "order_level", "cyclic"],
            )

        for batch in batches:
            for c, *edge in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                if c != chat and own:
                    yield done()
                    own = []
                chat = c
                own.append(tuple(edge))
        yield done()

    dealt = mine.repartition("chat").sortWithinPartitions("chat")
    return dealt.mapInArrow(run, "row long, order_turn long, order_level long, cyclic boolean")


def format_chats(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", tools: dict[str, dict] | None = None) -> DataFrame:
    kind = messages.schema[conv_col].dataType.simpleString()
    parsed = map_rows(
        messages, [F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text")], _parse_all(TOOLS if tools is None else tools),
        f"conv {kind}, turn long, role string, kind string, json string, calls array<struct<id:string,error:string,needs:array<string>>>, answers string",
    )
    key = F.coalesce(F.concat(F.lit("="), F.col("conv").cast("string")), F.lit("")).alias("chat")
    rows = materialise(parsed.withColumn("row", F.monotonically_increasing_id()), "messages")
    first = F.coalesce("turn", F.lit(-(2**62))).alias("turn")
    calls = rows.where("kind = 'calls'").select(key, first, "row", F.posexplode("calls").alias("pos", "call")).select("chat", "turn", "row", "pos", F.col("call.id").alias("id"), F.col("call.error").alias("error"), F.col("call.needs").alias("needs"))
    owner = calls.groupBy("chat", "id").agg(F.min(F.struct("turn", "row", "pos")).alias("o")).select("chat", "id", F.col("o.turn").alias("call_turn"), F.col("o.row").alias("call_row"), F.col("o.pos").alias("call_pos"))
    answers = rows.where("kind = 'result'").select(key, first, "row", F.col("answers").alias("id"))
    answered = answers.groupBy("chat", "id").agg(F.min(F.struct("turn", "row")).alias("a")).select("chat", "id", F.col("a.turn").alias("answer_turn"), F.col("a.row").alias("answer_row"))
    links = materialise(owner.hint("shuffle_hash").join(answered, ["chat", "id"], "left"), "links")

    edges = links.where("answer_row is not null").select("chat", F.col("call_row").alias("before"), F.col("call_turn").alias("before_turn"), F.col("answer_row").alias("after"), F.col("answer_turn").alias("after_turn"))
    wants = calls.select("chat", "turn", "row", F.explode("needs").alias("id")).distinct()
    needs = wants.join(links.where("answer_row is not null").hint("shuffle_hash"), ["chat", "id"]).select("chat", F.col("answer_row").alias("before"), F.col("answer_turn").alias("before_turn"), F.col("row").alias("after"), F.col("turn").alias("after_turn"))
    moves = _settle(materialise(edges.union(needs).where("before <> after"), "edges"))

    by_call = calls.join(links, ["chat", "id"]).groupBy("row").agg(
        F.sum(F.when((F.col("row") == F.col("call_row")) & (F.col("pos") == F.col("call_pos")) & F.col("answer_row").isNotNull(), 1).otherwise(0)).alias("n_answered"),
        F.count("error").alias("n_invalid"), F.array_sort(F.collect_list(F.when(F.col("error").isNotNull(), F.concat_ws(": ", "id", "error")))).alias("errors"),
    )
    by_answer = answers.join(links, ["chat", "id"], "left").select("row", F.when(F.col("call_row").isNull(), "orphan").when(F.col("row") == F.col("answer_row"), "result").otherwise("repeat").alias("linked"))
    out = rows.join(by_call, "row", "left").join(by_answer, "row", "left").join(moves, "row", "left")
    return out.select(
        "conv", "turn", F.coalesce("order_turn", "turn").alias("order_turn"), F.coalesce("order_level", F.lit(0).cast("long")).alias("order_level"), F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("linked", "kind").alias("kind"),
        F.size("calls").cast("long").alias("n_calls"), F.coalesce("n_answered", F.lit(0)).cast("long").alias("n_answered"), F.coalesce("n_invalid", F.lit(0)).cast("long").alias("n_invalid"), F.array_join(F.coalesce("errors", F.array().cast("array<string>")), " | ").alias("errors"),
        F.coalesce("cyclic", F.lit(False)).alias("cyclic"), "json",
    )


def op9_chat_formatting(spark, sf_dir: str) -> DataFrame:
    return format_chats(spark.read.parquet(f"{sf_dir}/conversations.parquet")).withColumnRenamed("conv", "conv_id")
