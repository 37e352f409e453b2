"""Chat formatting: links tool calls to their results and writes canonical JSON.

Turns are plain text, or JSON objects of these forms:
  system     {"tools": [{"name", "parameters": JSON schema}], "content"?}
  assistant  {"tool_calls": [{"id", "name", "arguments": object or its JSON text}], "content"?}
             (also with "function": {"name", "arguments"})
  tool       {"tool_call_id", "content"}
An argument {"$ref": id} stands for the result of another call, so that call must come first.
Anything else, broken JSON included, is a plain message with its text as content.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import stored

_KINDS = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}
_ITEM = "conv_id long, turn long, item int, kind string, call_id string, name string, body string, refs array<string>, json string"


def canonical(value: object) -> str:
    """JSON with sorted keys, no spaces, and other than ASCII characters as they are."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def violations(value: object, schema: dict, at: str = "$") -> list[str]:
    """Where value breaks the schema: type, enum, const, required, properties, additionalProperties, items, bounds and lengths."""
    if not isinstance(schema, dict):
        return [] if schema is not False else [f"{at}: not allowed"]
    if isinstance(value, dict) and set(value) == {"$ref"}:
        return []  # known only once the other call has run
    out = []
    kinds = schema.get("type", [])
    kinds = kinds if isinstance(kinds, list) else [kinds]
    number = isinstance(value, int | float) and not isinstance(value, bool)
    fits = lambda k: number if k == "number" else number and float(value).is_integer() if k == "integer" else isinstance(value, _KINDS.get(k, object))
    if kinds and not any(map(fits, kinds)):
        return [f"{at}: not {' or '.join(map(str, kinds))}"]
    if "enum" in schema and value not in schema["enum"]:
        out.append(f"{at}: not in enum")
    if "const" in schema and value != schema["const"]:
        out.append(f"{at}: not the constant")
    if number:
        out += [f"{at}: {k}" for k, bad in (("minimum", lambda b: value < b), ("maximum", lambda b: value > b), ("exclusiveMinimum", lambda b: value <= b), ("exclusiveMaximum", lambda b: value >= b)) if k in schema and bad(schema[k])]
    for kind, least, most in ((str, "minLength", "maxLength"), (list, "minItems", "maxItems")):
        if isinstance(value, kind):
            out += [f"{at}: {k}" for k, bad in ((least, lambda b: len(value) < b), (most, lambda b: len(value) > b)) if k in schema and bad(schema[k])]
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{at}.{k}: missing" for k in sorted(schema.get("required", [])) if k not in value]
        for k in sorted(value):
            if k in known:
                out += violations(value[k], known[k], f"{at}.{k}")
            elif schema.get("additionalProperties", True) is not True:
                out += violations(value[k], schema["additionalProperties"], f"{at}.{k}")
    if isinstance(value, list) and "items" in schema:
        out += [x for i, v in enumerate(value) for x in violations(v, schema["items"], f"{at}[{i}]")]
    return out


def _refs(value: object) -> list[str]:
    if isinstance(value, dict):
        return [str(value["$ref"])] if set(value) == {"$ref"} else [r for v in value.values() for r in _refs(v)]
    return [r for v in value for r in _refs(v)] if isinstance(value, list) else []


def _items(role: str | None, text: str | None) -> list[tuple]:
    """(kind, call_id, name, body, refs, json) of one turn: a message or result first, then calls or tool schemas."""

    def message(content: object) -> tuple:
        return ("message", None, None, None, [], canonical({"content": content, "role": role}))

    if not text or not text.lstrip().startswith("{"):
        return [message(text)]
    try:
        value = json.loads(text, parse_constant=lambda c: (_ for _ in ()).throw(ValueError(c)))
        if role == "tool" and "tool_call_id" in value:
            mark = str(value["tool_call_id"])
            return [("result", mark, None, None, [], canonical({"content": value.get("content"), "role": role, "tool_call_id": mark}))]
        if role == "assistant" and isinstance(value.get("tool_calls"), list):
            out = [message(value.get("content"))]
            for call in value["tool_calls"]:
                of = call.get("function", call)
                mark, name, args = None if call.get("id") is None else str(call["id"]), str(of["name"]), of.get("arguments", {})
                try:
                    args = json.loads(args) if isinstance(args, str) else args
                except ValueError:
                    pass  # stays a string, which no object schema admits
                out.append(("call", mark, name, canonical(args), sorted(set(_refs(args))), canonical({"arguments": args, "id": mark, "name": name})))
            return out
        if role == "system" and isinstance(value.get("tools"), list):
            out = [message(value.get("content"))]
            for tool in value["tools"]:
                of = tool.get("function", tool)
                name, schema = str(of["name"]), of.get("parameters", {})
                out.append(("tool", None, name, canonical(schema), [], canonical({"name": name, "parameters": schema})))
            return out
    except (ValueError, TypeError, KeyError, AttributeError, RecursionError):
        pass
    return [message(text)]


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in _ITEM.split(", ")]
    types = (pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string())
    for batch in batches:
        rows = [(c, t, i, *x) for c, t, role, text in zip(*(batch[n].to_pylist() for n in ("conv_id", "turn", "role", "text")), strict=True) for i, x in enumerate(_items(role, text))]
        cols = zip(*rows, strict=True) if rows else [[]] * len(names)
        yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)


def _check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for body, schema in zip(batch["body"].to_pylist(), batch["schema"].to_pylist(), strict=True):
            try:
                found.append(["unknown tool"] if schema is None else violations(json.loads(body), json.loads(schema)))
            except (TypeError, ValueError, AttributeError):
                found.append(["schema is malformed"])
        keep = [i for i, n in enumerate(batch.schema.names) if n != "schema"]
        yield pa.record_batch([*(batch.columns[i] for i in keep), pa.array(found, pa.list_(pa.string()))], [*(batch.schema.names[i] for i in keep), "errors"])


def _levels(needs: DataFrame, known: DataFrame) -> DataFrame:
    """(conv_id, call_id, level, after_turn) of calls by what they need.

    needs: distinct (conv_id, call_id, ref) between calls; known: (conv_id, call_id, turn, answered), answered the
    turn of the result or null. level is 0 without needs, else 2 more than the highest of those, null in a cycle;
    after_turn the latest turn of the call, those it needs and their results. Each step settles the
    calls whose needs are all settled; it ends when none is, however long a chain is.
    """
    key = ["conv_id", "call_id"]
    ready = lambda df: df.withColumn("done", F.greatest("after_turn", "answered"))
    needs = stored(needs, "needs")
    settled = stored(ready(known.join(needs, key, "left_anti").withColumns({"level": F.lit(0), "after_turn": F.col("turn")})), "level")
    left, newest, level = needs, settled, 0
    while left.limit(1).count() and newest.limit(1).count():
        level += 2
        still = stored(left.join(newest.select("conv_id", F.col("call_id").alias("ref")), ["conv_id", "ref"], "left_anti"), "needs")
        able = left.select(key).distinct().join(still, key, "left_anti")
        latest = needs.join(able, key).join(settled.select("conv_id", F.col("call_id").alias("ref"), "done"), ["conv_id", "ref"]).groupBy(key).agg(F.max("done").alias("latest"))
        newest = stored(ready(known.join(latest, key).withColumns({"level": F.lit(level), "after_turn": F.greatest("turn", "latest")}).drop("latest")), "level")
        settled, left = settled.unionByName(newest), still
    cyclic = known.join(left.select(key).distinct(), key, "left_semi")
    return settled.select(*key, "level", "after_turn").unionByName(cyclic.select(*key, F.lit(None).cast("int").alias("level"), F.col("turn").alias("after_turn")))


def format_chats(turns: DataFrame) -> DataFrame:
    """One row for each item (message, call, result, tool) of each turn of (conv_id, turn, role, text).

    Columns: conv_id, turn, item, kind, call_id, name, level, after_turn, linked, errors, json. A call or result is
    linked if its conversation has a partner with its identifier; of repeated identifiers the first call (by turn,
    then item) is meant, others are errors. Items sorted by (after_turn, level, turn, item) are in topological
    order: after_turn is the latest turn among the item, its call and what that needs through "$ref";
    level rises along such needs (null: they form a cycle). json is canonical. Null texts are messages with null
    content; items with a null conv_id or identifier link to nothing; repeated rows give rows
    each. An empty table gives an empty result; other columns are left out.
    """
    key, none = ["conv_id", "call_id"], F.array().cast("array<string>")
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    items = stored(rows.mapInArrow(_parse, _ITEM), "items")
    first = Window.partitionBy(key).orderBy("turn", "item", "json")
    named = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    calls = items.where("kind = 'call'").withColumn("nth", F.when(named, F.row_number().over(first)))
    of_tool = Window.partitionBy("conv_id", "name").orderBy(F.desc("turn"), F.desc("item"), "body")
    tools = items.where("kind = 'tool'").withColumn("r", F.row_number().over(of_tool)).where("r = 1").select("conv_id", "name", F.col("body").alias("schema"))
    checked = calls.join(tools, ["conv_id", "name"], "left").select(*items.columns, "nth", "schema")
    checked = stored(checked.mapInArrow(_check, _ITEM + ", nth int, errors array<string>"), "checked")
    results = items.where("kind = 'result'")
    answers = results.groupBy(key).agg(F.min("turn").alias("answered"))
    known = checked.where("nth = 1").join(answers, key, "left").select(*key, "turn", "answered", "refs")
    known = stored(known, "calls")
    wanted = known.select(*key, F.explode("refs").alias("ref")).distinct()
    others = known.select("conv_id", F.col("call_id").alias("ref"))
    level = stored(_levels(wanted.join(others, ["conv_id", "ref"], "left_semi"), known.drop("refs")), "levels")
    lost = wanted.join(others, ["conv_id", "ref"], "left_anti").groupBy(key).agg(F.sort_array(F.collect_set(F.concat(F.lit("no call "), "ref"))).alias("lost"))
    state = level.join(known.select(*key, F.col("answered").isNotNull().alias("linked")), key).join(lost, key, "left").withColumn("nth", F.lit(1))
    mark = lambda when, say: F.when(when, F.array(F.lit(say))).otherwise(none)
    whys = F.concat("errors", mark(F.col("call_id").isNull(), "no identifier"), mark(F.coalesce(F.col("nth") > 1, F.lit(False)), "identifier repeats"), mark((F.col("nth") == 1) & F.col("level").isNull(), "needs form a cycle"), F.coalesce("lost", none))
    called = checked.join(state, [*key, "nth"], "left").select(*items.columns, "level", F.coalesce("after_turn", "turn").alias("after_turn"), F.coalesce("linked", F.lit(False)).alias("linked"), whys.alias("errors"))
    at = level.select(*key, F.col("level").alias("l"), F.col("after_turn").alias("a")).withColumn("linked", F.lit(True))
    answered = results.join(at, key, "left").select(*items.columns, (F.col("l") + 1).alias("level"), F.greatest("turn", "a").alias("after_turn"), F.coalesce("linked", F.lit(False)).alias("linked"), mark(F.col("linked").isNull(), "no such call").alias("errors"))
    rest = items.where("kind in ('message', 'tool')").select("*", F.lit(0).alias("level"), F.col("turn").alias("after_turn"), F.lit(None).cast("boolean").alias("linked"), none.alias("errors"))
    return rest.unionByName(called).unionByName(answered).select("conv_id", "turn", "item", "kind", "call_id", "name", "level", "after_turn", "linked", "errors", "json")
