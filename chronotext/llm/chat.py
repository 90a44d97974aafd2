"""Chat formatting with linked tool calls.

Calls and results are joined by identifier, ordered so that a call follows the
calls whose results its arguments name, validated against the tools' schemas,
and written as canonical JSON (sorted keys, no spaces, one spelling of
numbers and strings), one message a row.
"""

from __future__ import annotations

import itertools
import json
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import running_index
from .common import ship_package, stored, to_batches

REFERENCE = "$result"  # {"$result": "call id"} in arguments stands for another call's result
BLOCK = 250_000  # references whose calls a task settles together
_SURROGATE = re.compile("[\ud800-\udfff]")
CALL_FIELDS = ("conv_id", "turn", "role", "text", "call_id", "name", "arguments")


def canonical(value) -> str:
    """JSON with sorted keys and no spaces; whole floats as integers, lone surrogates escaped, NaN and infinities refused."""
    def plain(v):
        if isinstance(v, dict):
            return {str(k): plain(x) for k, x in v.items()}
        if isinstance(v, list):
            return [plain(x) for x in v]
        if isinstance(v, float) and math.isfinite(v) and v == int(v) and abs(v) < 2 ** 53:
            return int(v)
        return v
    return _escaped(json.dumps(plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False))


def _escaped(text: str) -> str:
    """Halves of surrogate pairs that stand alone, legal in JSON but in no encoding, as escapes."""
    return _SURROGATE.sub(lambda m: f"\\u{ord(m.group()):04x}", text)


def references(value) -> list[str]:
    """Identifiers of the calls that arguments refer to, sorted."""
    found, todo = set(), [value]
    while todo:
        v = todo.pop()
        if isinstance(v, dict):
            if set(v) == {REFERENCE} and isinstance(v[REFERENCE], str):
                found.add(v[REFERENCE])
            else:
                todo += v.values()
        elif isinstance(v, list):
            todo += v
    return sorted(found)


_TYPES = {"string": str, "boolean": bool, "object": dict, "array": list, "null": type(None)}


def _is(v, kind: str) -> bool:
    if kind in ("number", "integer"):
        return not isinstance(v, bool) and (isinstance(v, int) or isinstance(v, float) and (kind == "number" or v == int(v)))
    return isinstance(v, _TYPES.get(kind, object))


def violations(value, schema: dict, path: str = "") -> list[str]:
    """Where a value breaks a JSON schema (type, enum, required, properties, additionalProperties, items, bounds, pattern)."""
    if isinstance(value, dict) and set(value) == {REFERENCE}:
        return []  # known only when the other call has run
    here = path or "."
    kinds = schema.get("type")
    if kinds is not None and not any(_is(value, k) for k in ([kinds] if isinstance(kinds, str) else kinds)):
        return [f"{here}:type"]
    out = []
    if "enum" in schema and value not in schema["enum"]:
        out.append(f"{here}:enum")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{path}.{k}:required" for k in schema.get("required", []) if k not in value]
        for k in sorted(value):
            if k in known:
                out += violations(value[k], known[k], f"{path}.{k}")
            elif schema.get("additionalProperties", True) is False:
                out.append(f"{path}.{k}:unknown")
    elif isinstance(value, list):
        if "items" in schema:
            for k, v in enumerate(value):
                out += violations(v, schema["items"], f"{path}[{k}]")
    elif isinstance(value, str):
        if len(value) < schema.get("minLength", 0) or len(value) > schema.get("maxLength", len(value)):
            out.append(f"{here}:length")
        if "pattern" in schema and not re.search(schema["pattern"], value):
            out.append(f"{here}:pattern")
    elif isinstance(value, (int, float)) and not isinstance(value, bool):
        if value < schema.get("minimum", value) or value > schema.get("maximum", value):
            out.append(f"{here}:range")
    return out


def format_chats(messages: DataFrame, tools: dict[str, dict]) -> DataFrame:
    """One row per message: ``conv_id, turn, role, call_id, position, depth, status, errors, message``.

    ``messages`` has ``conv_id, turn, role, text, call_id, name, arguments``: a
    call has a ``name`` and JSON ``arguments``; a result has role ``tool`` and
    the ``call_id`` it answers. ``status``: ``message``; for calls ``ok``,
    ``bad_json``, ``unknown_tool``, ``invalid``, ``repeated_id`` (an earlier call
    of the conversation has the id), ``missing_reference``, ``cycle`` (its
    references lead into a cycle, however long the chain before it), and
    ``unanswered`` for an otherwise sound call without a result; for results
    ``linked``, ``repeated_result`` or ``orphan``. ``depth`` is 0 for a call that
    refers to none, else one more than the deepest it refers to, and -1 in a
    cycle. Messages are in the order of turns, but a call follows all it refers
    to and a result its call, if need be in a later turn's place; in one place
    plain messages come first, then calls by depth, each before its results.
    ``message`` is canonical JSON with the call's arguments as an object, or the
    text as a string, a surrogate that stands alone in arguments as its escape.
    Null texts are empty; null conversations and turns are
    values like any other; a null identifier links with nothing; repeated rows
    keep their rows; other columns are not read; an empty table gives an empty
    table. A conversation is never collected: links are joins, and the order is
    a sort.
    """
    spark = messages.sparkSession
    ship_package(spark)
    src = messages.select(*(F.col(c) for c in CALL_FIELDS))
    checked = pa.schema([("status", pa.string()), ("errors", pa.string()), ("refs", pa.list_(pa.string())),
                         ("canonical_arguments", pa.string())])
    extra = "status string, errors string, refs array<string>, canonical_arguments string"
    is_call = F.col("name").isNotNull() & (F.coalesce(F.col("role"), F.lit("")) != "tool")
    keyed = stored(spark, src.withColumn("row", F.monotonically_increasing_id()).withColumn("is_call", is_call), "messages")
    calls = keyed.where("is_call")
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in calls.schema.fields) + ", " + extra

    def check(batches):
        for b in batches:
            cols = [[], [], [], []]
            for name, text in zip(b.column("name").to_pylist(), b.column("arguments").to_pylist(), strict=True):
                for c, v in zip(cols, _checked(name, text, tools), strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(c, type=f.type) for c, f in zip(cols, checked, strict=True))],
                                             names=[*b.schema.names, *checked.names])

    calls = calls.mapInArrow(check, ddl)
    calls = stored(spark, calls, "checked_calls")
    first = (calls.where("call_id is not null").groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "row")).alias("least"))
             .select(F.col("least.row").alias("row"), F.lit(1).alias("nth")))
    nth = F.when(F.col("call_id").isNull(), 1).otherwise(F.coalesce("nth", F.lit(2)))
    calls = stored(spark, calls.join(first, "row", "left").withColumn("nth", nth)
                   .withColumn("status", F.when((F.col("nth") > 1) & (F.col("status") == "ok"), F.lit("repeated_id"))
                               .otherwise(F.col("status"))), "calls")
    named = calls.where("nth = 1 and call_id is not null").select("conv_id", F.col("call_id"), F.col("row").alias("call_row"))
    depth = _depths(spark, calls, named)
    results = keyed.where("not is_call and role = 'tool'")
    here = named.withColumnRenamed("conv_id", "c").withColumnRenamed("call_id", "i")
    linked = results.join(here, results.conv_id.eqNullSafe(here.c) & (results.call_id == here.i), "left").drop("c", "i")
    linked = stored(spark, linked, "linked_results")
    first = (linked.where("call_row is not null").groupBy("call_row").agg(F.min(F.struct("turn", "row")).alias("least"))
             .select(F.col("least.row").alias("row"), F.lit(1).alias("nth")))
    linked = stored(spark, linked.join(first, "row", "left").withColumn(
        "nth", F.when(F.col("call_row").isNotNull(), F.coalesce("nth", F.lit(2)))), "results")
    answered = linked.where("nth = 1").select(F.col("call_row").alias("row"), F.lit(True).alias("answered"))
    calls = (calls.join(depth, "row", "left").join(answered, "row", "left")
             .withColumn("status", F.when(F.col("status") != "ok", F.col("status"))
                         .when(F.col("missing"), "missing_reference").when(F.col("depth") < 0, "cycle")
                         .when(F.col("answered").isNull(), "unanswered").otherwise("ok")))
    joined = linked.join(depth.select(F.col("row").alias("call_row"), "depth", "after"), "call_row", "left")
    common = ["conv_id", "turn", "role", "text", "call_id", "name", "row"]
    none = F.lit(None).cast("string")
    every = (calls.select(*common, "after", "depth", "status", "errors", "canonical_arguments", F.lit(1).alias("rank"))
             .unionByName(joined.select(*common, F.greatest("turn", "after").alias("after"), "depth", F.when(F.col("call_row").isNull(), "orphan").when(F.col("nth") > 1, "repeated_result")
                                        .otherwise("linked").alias("status"), F.lit("").alias("errors"),
                                        none.alias("canonical_arguments"), F.lit(2).alias("rank")))
             .unionByName(keyed.where("not is_call and coalesce(role, '') <> 'tool'").select(
                 *common, F.col("turn").alias("after"), F.lit(None).cast("int").alias("depth"), F.lit("message").alias("status"), F.lit("").alias("errors"),
                 none.alias("canonical_arguments"), F.lit(0).alias("rank"))))
    late = F.when(F.col("rank") == 0, -1).when(F.col("depth") >= 0, F.col("depth")).otherwise((1 << 31) - 1)
    every = stored(spark, every.withColumn("late", late), "placed_messages")
    # ranked by their keys alone, in a range sort that divides a long conversation
    keys = every.select(F.col("conv_id").isNull().alias("no_conv"), F.coalesce("conv_id", F.lit(0)).alias("conv"), "after", "late", "rank", "turn", "row")
    places = (running_index(keys, ["no_conv", "conv"], ["after", "late", "rank", "turn", "row"], "place")
              .select("row", (F.col("place") + 1).cast("long").alias("position")))
    placed = every.join(places, "row").drop("row", "rank", "after", "late")
    out = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("call_id", pa.string()),
                     ("position", pa.int64()), ("depth", pa.int32()), ("status", pa.string()), ("errors", pa.string()),
                     ("message", pa.string())])

    def write(batches):
        def rows():
            for b in batches:
                cols = ("conv_id", "turn", "role", "call_id", "position", "depth", "status", "errors", "text", "name", "canonical_arguments")
                for r in zip(*(b.column(c).to_pylist() for c in cols), strict=True):
                    *kept, text, name, arguments = r
                    body = {"role": kept[2] or "", "content": text or ""}
                    if name is not None and kept[6] not in ("linked", "orphan", "repeated_result", "message"):
                        body["tool_call"] = {"id": kept[3], "name": name,
                                             "arguments": None if arguments is None else json.loads(arguments)}
                    elif kept[3] is not None:
                        body["tool_call_id"] = kept[3]
                    yield (*kept, canonical(body))
        yield from to_batches(rows(), out)

    return (placed.withColumn("conv_id", F.col("conv_id").cast("long")).withColumn("turn", F.col("turn").cast("long"))
            .withColumn("depth", F.col("depth").cast("int"))
            .mapInArrow(write, "conv_id long, turn long, role string, call_id string, position long, depth int, "
                               "status string, errors string, message string"))


def _checked(name, text, tools) -> tuple:
    """Status, errors, references and canonical arguments of one call."""
    try:
        value = json.loads(text if text is not None else "{}", parse_constant=_refuse)
        canonical([[[[value]]]])  # as deep as in the message that is written from it
        written = canonical(value)
    except (ValueError, RecursionError):
        return "bad_json", "", [], None
    # no identifier of a table holds a lone surrogate: such a reference is missing
    refs = [None if _SURROGATE.search(r) else r for r in references(value)]
    if name not in tools:
        return "unknown_tool", "", refs, written
    errors = violations(value, tools[name])
    return ("invalid" if errors else "ok"), _escaped(",".join(errors)), refs, written


def _refuse(name):
    raise ValueError(name)


def _depths(spark, calls: DataFrame, named: DataFrame) -> DataFrame:
    """``(row, depth, after, missing)``: rounds settle calls whose references are settled, until one settles none.

    ``depth`` is -1 where none can; ``after`` is the latest turn of the call and of all that it refers to.
    A round follows references within a block of neighbouring calls to their end, so there are about as many
    rounds as a chain changes blocks, not as it has calls.
    """
    target = named.withColumnRenamed("conv_id", "c").withColumnRenamed("call_id", "i")
    asked = calls.select("row", "turn", "conv_id", F.explode("refs").alias("ref"))
    edges = stored(spark, asked.join(target, asked.conv_id.eqNullSafe(target.c) & (asked.ref == target.i), "left")
                   .select("conv_id", "row", "turn", F.col("call_row").alias("needs")), "references")
    lost = edges.where("needs is null").select("row", F.lit(True).alias("missing")).distinct()
    edges = edges.where("needs is not null").distinct()
    fresh = stored(spark, calls.join(edges.select("row").distinct(), "row", "left_anti")
                   .select("row", F.lit(0).alias("depth"), F.col("turn").cast("long").alias("after")), "depths")
    settled = fresh
    # open references, filled in with what the latest round has settled; every round reads stored tables alone
    pending = edges.select("conv_id", "row", F.col("turn").cast("long").alias("turn"), "needs",
                           F.lit(None).cast("int").alias("depth"), F.lit(None).cast("long").alias("after"))
    blocks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(edges.count() / BLOCK))
    for n in itertools.count():
        news = fresh.select(F.col("row").alias("needs"), F.col("depth").alias("d"), F.col("after").alias("a"))
        filled = stored(spark, pending.join(news, "needs", "left").select(
            "conv_id", "row", "turn", "needs", F.coalesce("depth", "d").alias("depth"), F.coalesce("after", "a").alias("after")), "filled")
        # another number of blocks every other time, so that what one border cuts is whole in the next round
        fresh = stored(spark, filled.repartitionByRange(blocks + n % 2, "conv_id", "turn", "row")
                       .select("row", "turn", "needs", "depth", "after").mapInArrow(_settle, "row long, depth int, after long"), "ready")
        if fresh.isEmpty():
            break
        settled = settled.unionByName(fresh)
        if n % 16 == 15:  # keeps the plan short
            settled = stored(spark, settled, "settled")
        pending = filled.join(fresh, "row", "left_anti")
    return stored(spark, calls.select("row", "turn").join(settled, "row", "left").join(lost, "row", "left")
                  .select("row", F.coalesce("depth", F.lit(-1)).alias("depth"), F.coalesce("after", "turn").alias("after"),
                          F.coalesce("missing", F.lit(False)).alias("missing")), "call_depths")


def _settle(batches):
    """``(row, depth, after)`` of the calls of a block that need only calls settled before or in the block.

    All references of a call are in one block.
    """
    def later(a, b):
        return a if b is None else b if a is None else max(a, b)

    found: dict[int, list] = {}  # open references, greatest depth referred to, latest turn
    callers: dict[int, list[int]] = {}
    for b in batches:
        for row, turn, needs, depth, after in zip(*(b.column(c).to_pylist() for c in ("row", "turn", "needs", "depth", "after")), strict=True):
            call = found.setdefault(row, [0, -1, turn])
            if depth is None:
                call[0] += 1
                callers.setdefault(needs, []).append(row)
            else:
                call[1:] = max(call[1], depth), later(call[2], after)

    def rows():
        todo = [row for row, call in found.items() if not call[0]]
        while todo:
            row = todo.pop()
            _, deepest, after = found[row]
            yield row, deepest + 1, after
            for caller in callers.get(row, ()):
                call = found[caller]
                call[:] = call[0] - 1, max(call[1], deepest + 1), later(call[2], after)
                if not call[0]:
                    todo.append(caller)
    yield from to_batches(rows(), pa.schema([("row", pa.int64()), ("depth", pa.int32()), ("after", pa.int64())]))


TOOLS = {
    "lookup": {"type": "object", "required": ["query"], "additionalProperties": False,
               "properties": {"query": {"type": "string", "minLength": 1}, "limit": {"type": "integer", "minimum": 1, "maximum": 50},
                              "after": {"type": "object"}}},
    "measure": {"type": "object", "required": ["text", "unit"], "additionalProperties": False,
                "properties": {"text": {"type": "string"}, "unit": {"type": "string", "enum": ["words", "characters"]}}},
}


def stand_in(conversations: DataFrame) -> DataFrame:
    """Messages with tool calls made from plain conversations, which have none.

    Every assistant turn also makes a call, and every user turn brings the
    result of the call of the turn before. Arguments hold the turn's own text.
    """
    t = F.coalesce(F.col("text"), F.lit(""))
    base = conversations.select(F.col("conv_id"), F.col("turn"), F.col("role"), F.col("text"))
    none = F.lit(None).cast("string")
    plain = base.select("*", none.alias("call_id"), none.alias("name"), none.alias("arguments"))
    lookup = F.to_json(F.struct(F.col("turn").cast("int").alias("limit"), F.substring_index(t, " ", 6).alias("query"),
                                F.when(F.col("turn") > 1, F.struct(F.concat(F.lit("call-"), F.col("turn") - 2).alias(REFERENCE))).alias("after")))
    measure = F.to_json(F.struct(F.substring_index(t, ".", 1).alias("text"), F.when(F.length(t) % 2 == 0, "words").otherwise("pages").alias("unit")))
    even = F.length(t) % 3 > 0
    calls = base.where("role = 'assistant'").select(
        "conv_id", "turn", "role", "text", F.concat(F.lit("call-"), F.col("turn")).alias("call_id"),
        F.when(even, "lookup").otherwise("measure").alias("name"), F.when(even, lookup).otherwise(measure).alias("arguments"))
    results = base.where("role = 'user'").select(
        "conv_id", "turn", F.lit("tool").alias("role"), "text", F.concat(F.lit("call-"), F.col("turn") - 1).alias("call_id"),
        none.alias("name"), none.alias("arguments"))
    return plain.unionByName(calls).unionByName(results)
