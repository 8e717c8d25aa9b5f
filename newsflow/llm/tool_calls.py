"""Chat formatting: tool calls and their results, linked, ordered, checked and written as canonical JSON.

Calls and results meet by a hash join on their identifier; identifiers that very many results share are joined by broadcast
instead. The topological order places a result after its call, and a call after the first result of every call that it
`needs`; apart from that rows stand by turn. Every row gets the least place (turn, depth) that is no earlier than its own
turn and later than all it waits for; the sorted places are numbered without gaps. Calls are placed in rounds, one for each
step of the longest chain of needs; those left when a round places none wait for each other in a circle.

Arguments are validated against the tool's JSON schema at every depth. JSON is canonical: names in order, no white space, a number in
one form whatever its spelling (exact digits, without exponent from 1e-6 up to 1e21), so 1e2, 100 and 100.0 are all 100.

Defined results: rows without an identifier link with nothing; of several calls with one identifier the first (smallest turn) is the
one that results link to; every result links, several too; an unknown tool, malformed or doubled names, each violated rule, needs without a
result and circles are listed in `errors`; rows of a null or unknown kind count as messages and say so; null texts are JSON nulls; very long
texts are kept whole; repeated rows stay, in any order among each other; null turns come first; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from decimal import Decimal, InvalidOperation

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsflow.llm.common import discard, join_hot, materialize

#: Schema keywords that are checked, and those that say nothing about a value.
CHECKED = {"type", "enum", "const", "properties", "required", "additionalProperties", "minProperties", "maxProperties", "items", "minItems", "maxItems", "uniqueItems", "minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "minLength", "maxLength", "pattern", "anyOf", "oneOf", "allOf", "not"}
SILENT = {"title", "description", "default", "examples", "$schema", "$id", "$comment"}
_SURROGATE = re.compile("[\ud800-\udfff]")


def _number(text: str) -> int | Decimal:
    value = Decimal(text)
    # exponents beyond all use would make integers of as many digits
    return int(value) if value.is_zero() or 0 <= value.normalize().as_tuple().exponent <= 400 and value.adjusted() <= 4000 else value


def parse_json(text: str) -> tuple[object, list[str]]:
    """The value and the names that an object holds twice; raises ValueError for what is no JSON."""
    twice: list[str] = []

    def pairs(items: list[tuple[str, object]]) -> dict:
        got = dict(items)
        if len(got) < len(items):
            names = [k for k, _ in items]
            twice.extend(sorted({k for k in names if names.count(k) > 1}))
        return got

    def refuse(name: str) -> None:
        raise ValueError(name)

    try:
        return json.loads(text, parse_float=_number, parse_int=_number, parse_constant=refuse, object_pairs_hook=pairs), twice
    except (RecursionError, InvalidOperation) as e:
        raise ValueError(str(e)) from e


def canonical(value: object) -> str:
    """Canonical JSON of a parsed value."""
    if isinstance(value, dict):
        return "{" + ",".join(f"{canonical(k)}:{canonical(value[k])}" for k in sorted(value)) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(canonical, value)) + "]"
    if isinstance(value, str):
        return _SURROGATE.sub(lambda m: f"\\u{ord(m.group()):04x}", json.dumps(value, ensure_ascii=False))
    if value is None or isinstance(value, bool):
        return json.dumps(value)
    sign, digits, exponent = Decimal(value).as_tuple()
    shown = "".join(map(str, digits)).lstrip("0")
    exponent += len(shown) - len(shown := shown.rstrip("0"))
    if not shown:
        return "0"
    point = len(shown) + exponent
    if exponent >= 0 and point <= 21:
        plain = shown + "0" * exponent
    elif 0 < point <= 21:
        plain = f"{shown[:point]}.{shown[point:]}"
    elif -6 < point <= 0:
        plain = "0." + "0" * -point + shown
    else:
        plain = shown[0] + ("." + shown[1:] if len(shown) > 1 else "") + f"e{point - 1:+d}"
    return "-" * sign + plain


def _is(value: object, kind: str) -> bool:
    number = isinstance(value, int | Decimal) and not isinstance(value, bool)
    return {
        "object": isinstance(value, dict), "array": isinstance(value, list), "string": isinstance(value, str), "boolean": isinstance(value, bool),
        "null": value is None, "number": number, "integer": number and (isinstance(value, int) or value == value.to_integral_value()),
    }[kind]


def check_schema(schema: dict | bool) -> None:
    """Raise ValueError for keywords that would not be checked."""
    if isinstance(schema, bool):
        return
    if odd := sorted(set(schema) - CHECKED - SILENT):
        raise ValueError(f"schema keywords that are not supported: {', '.join(odd)}")
    inner = [*schema.get("properties", {}).values(), *(s for k in ("anyOf", "oneOf", "allOf") for s in schema.get(k, []))]
    for s in inner + [schema[k] for k in ("additionalProperties", "items", "not") if k in schema]:
        check_schema(s)


def violations(value: object, schema: dict | bool, path: str = "") -> Iterator[str]:
    """The rules that the value breaks, each with the path of what breaks it."""
    if isinstance(schema, bool):
        if not schema:
            yield f"{path or 'value'}: not allowed"
        return
    say = lambda what: f"{path}: {what}" if path else what
    if "type" in schema:
        kinds = schema["type"] if isinstance(schema["type"], list) else [schema["type"]]
        if not any(_is(value, k) for k in kinds):
            yield say(f"not {'/'.join(kinds)}")
            return
    same = canonical(value)
    if "enum" in schema and same not in {canonical(_own(x)) for x in schema["enum"]}:
        yield say("not in enum")
    if "const" in schema and same != canonical(_own(schema["const"])):
        yield say("not the constant")
    size = {dict: "Properties", list: "Items", str: "Length"}.get(type(value))
    if size and len(value) < schema.get(f"min{size}", 0):
        yield say(f"less than min{size}")
    if size and len(value) > schema.get(f"max{size}", len(value)):
        yield say(f"more than max{size}")
    if _is(value, "number"):
        limits = {"minimum": lambda a, b: a >= b, "maximum": lambda a, b: a <= b, "exclusiveMinimum": lambda a, b: a > b, "exclusiveMaximum": lambda a, b: a < b}
        yield from (say(f"beyond {k}") for k, holds in limits.items() if k in schema and not holds(Decimal(value), Decimal(str(schema[k]))))
    if isinstance(value, str) and "pattern" in schema and not re.search(schema["pattern"], value):
        yield say("no match of pattern")
    if isinstance(value, dict):
        known, at = schema.get("properties", {}), f"{path}." if path else ""
        yield from (f"{at}{k}: missing" for k in schema.get("required", []) if k not in value)
        for k in sorted(value):
            if k in known:
                yield from violations(value[k], known[k], at + k)
            elif schema.get("additionalProperties", True) is False:
                yield f"{at}{k}: unknown property"
            else:
                yield from violations(value[k], schema.get("additionalProperties", True), at + k)
    if isinstance(value, list):
        for i, x in enumerate(value):
            yield from violations(x, schema.get("items", True), f"{path}[{i}]")
        if schema.get("uniqueItems") and len(set(map(canonical, value))) < len(value):
            yield say("repeated items")
    fits = lambda s: next(violations(value, s, path), None) is None
    for s in schema.get("allOf", []):
        yield from violations(value, s, path)
    if "anyOf" in schema and not any(map(fits, schema["anyOf"])):
        yield say("none of anyOf")
    if "oneOf" in schema and sum(map(fits, schema["oneOf"])) != 1:
        yield say("not one of oneOf")
    if "not" in schema and fits(schema["not"]):
        yield say("not allowed")


def _own(value: object) -> object:
    """A value of the schema as parse_json makes it."""
    return parse_json(json.dumps(value))[0]


def _formatted(kind: str | None, role: str | None, call_id: str | None, name: str | None, content: str | None, schemas: dict[str, dict]) -> tuple[list[str], str]:
    """Errors of a row by itself, and its canonical JSON."""
    errors: list[str] = []
    if kind == "call":
        arguments, shown = None, content
        try:
            arguments, twice = parse_json(content or "")
            errors += [f"{n}: named twice" for n in twice]
            shown = arguments
        except ValueError:
            errors.append("malformed arguments")
        else:
            if not isinstance(arguments, dict):
                errors.append("not an object")
            elif name in schemas:
                errors += violations(arguments, schemas[name])
        if name not in schemas:
            errors.append("unknown tool")
        return errors, canonical({"arguments": shown, "call_id": call_id, "name": name, "role": role})
    if kind == "result":
        return errors, canonical({"call_id": call_id, "content": content, "role": role})
    return [] if kind == "message" else ["unknown kind"], canonical({"content": content, "role": role})



def _placed_calls(calls: DataFrame, uses: DataFrame) -> DataFrame:
    """calls: rid, conv_id, turn, key, needs; uses: key, first_call (turn, rid), result_turn. rid, place (turn, depth), lost (needs that
    have no result) and circle for every call."""
    own = F.struct(F.col("turn").alias("t"), F.lit(0).alias("d"))
    known = calls.where(F.coalesce(F.size("needs"), F.lit(0)) <= 0).select("rid", own.alias("place"))
    edges = calls.where(F.size("needs") > 0).select("rid", own.alias("own"), "conv_id", F.explode(F.array_distinct("needs")).alias("need"))
    edges = edges.select("rid", "own", "need", F.struct("conv_id", F.col("need").alias("call_id")).alias("key")).join(uses, "key", "left")
    edges = materialize(edges.select("rid", "own", "need", F.col("first_call.rid").alias("of"), "result_turn"))
    there = F.col("of").isNotNull() & F.col("result_turn").isNotNull()
    waits = materialize(edges.groupBy("rid").agg(F.first("own").alias("own"), F.count_if(there).alias("waits"), F.array_sort(F.collect_list(F.when(~there, F.col("need")))).alias("lost")))
    edges = edges.where(there).select("rid", "of", "result_turn")
    known = materialize(known.select("*", F.lit(None).cast("array<string>").alias("lost")).unionByName(waits.where("waits = 0").select("rid", F.col("own").alias("place"), "lost")))
    left = waits.where("waits > 0").count()
    while left:
        # a need's result comes after its call, and the call that waits for it after that result
        ready = edges.join(known.select(F.col("rid").alias("of"), "place"), "of").join(known.select("rid"), "rid", "left_anti")
        result = F.greatest(F.struct(F.col("result_turn").alias("t"), F.lit(0).alias("d")), F.struct(F.col("place.t").alias("t"), (F.col("place.d") + 1).alias("d")))
        ready = ready.select("rid", result.alias("r")).groupBy("rid").agg(F.count("*").alias("n"), F.max("r").alias("r"))
        new = ready.join(waits, "rid").where("n = waits").select("rid", F.greatest(F.col("own"), F.struct(F.col("r.t").alias("t"), (F.col("r.d") + 1).alias("d"))).alias("place"), "lost")
        new = materialize(new)
        if not (n := new.count()):
            break
        left -= n
        known = materialize(known.unionByName(new))
    circles = waits.join(known.select("rid"), "rid", "left_anti").select("rid", F.col("own").alias("place"), "lost", F.lit(True).alias("circle"))
    return materialize(known.withColumn("circle", F.lit(False)).unionByName(circles))


def link_tool_calls(messages: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """messages: conv_id, turn, role, kind ('message', 'call', 'result'), call_id, name, content (a call's arguments as JSON, else
    text), and, if there is such a column, needs (ids of the calls whose results a call uses). Returns conv_id, turn, role, kind, call_id,
    linked, errors, position (from 0 in each conversation, in topological order), json."""
    for schema in schemas.values():
        check_schema(schema)
    has_needs = "needs" in messages.columns
    needs = F.col("needs").cast("array<string>") if has_needs else F.lit(None).cast("array<string>")
    key = F.when(F.col("call_id").isNotNull() & F.col("conv_id").isNotNull(), F.struct("conv_id", "call_id"))
    rows = materialize(messages.select("conv_id", "turn", "role", "kind", "call_id", "name", "content", needs.alias("needs"), key.alias("key"), F.monotonically_increasing_id().alias("rid")))
    call, result = F.col("kind") == "call", F.col("kind") == "result"
    uses = rows.where(F.col("key").isNotNull() & (call | result)).groupBy("key").agg(F.min(F.when(call, F.struct("turn", "rid"))).alias("first_call"), F.min(F.when(result, F.col("turn"))).alias("result_turn"), F.count_if(result).alias("n_results"), F.count("*").alias("uses"))
    uses = materialize(uses)
    calls = rows.where(call).select("rid", "conv_id", "turn", "key", "needs")
    if has_needs:
        placed = _placed_calls(calls, uses)
    else:
        placed = calls.select("rid", F.struct(F.col("turn").alias("t"), F.lit(0).alias("d")).alias("place"), F.lit(None).cast("array<string>").alias("lost"), F.lit(False).alias("circle"))
    of_first = uses.join(placed.select(F.col("rid").alias("first"), F.col("place").alias("call_place")), F.col("first_call.rid") == F.col("first"), "left").select("key", "call_place", "n_results", "uses")
    of_first = materialize(of_first)
    mine = ["conv_id", "turn", "role", "kind", "call_id", "name", "content", "rid", "key"]
    linkable = rows.where(F.col("key").isNotNull() & (call | result)).select(*mine)
    both = join_hot(linkable, of_first, "key", "uses", max(1, linkable.count()))
    rest = rows.where(~(F.col("key").isNotNull() & F.coalesce(call | result, F.lit(False)))).select(*mine, F.lit(None).cast(of_first.schema["call_place"].dataType).alias("call_place"), F.lit(0).cast("long").alias("n_results"), F.lit(0).cast("long").alias("uses"))
    every = both.unionByName(rest).join(placed.withColumnRenamed("place", "own_place"), "rid", "left")
    own = F.struct(F.col("turn").alias("t"), F.lit(0).alias("d"))
    after = F.when(F.col("call_place").isNotNull(), F.greatest(own, F.struct(F.col("call_place.t").alias("t"), (F.col("call_place.d") + 1).alias("d"))))
    place = F.when(call, F.col("own_place")).when(result, F.coalesce(after, own)).otherwise(own)
    linked = F.when(call, F.col("n_results") > 0).when(result, F.col("call_place").isNotNull())

    @F.pandas_udf("struct<errors array<string>, json string>")
    def formatted(parts: pd.DataFrame) -> pd.DataFrame:
        from newsflow.llm import tool_calls

        columns = [parts[c].where(parts[c].notna(), None).tolist() for c in ("kind", "role", "call_id", "name", "content")]
        return pd.DataFrame([tool_calls._formatted(*r, schemas) for r in zip(*columns, strict=True)], columns=["errors", "json"])

    made = every.select("*", place.alias("place"), linked.alias("linked"), formatted(F.struct("kind", "role", "call_id", "name", "content")).alias("made"))
    none = F.array().cast("array<string>")
    said = F.concat(
        "made.errors",
        F.coalesce(F.transform("lost", lambda x: F.concat(F.lit("needs a result: "), F.coalesce(x, F.lit("null")))), none),
        F.when(F.col("circle"), F.array(F.lit("circle of needs"))).otherwise(none),
        F.when(call & ~F.col("linked"), F.array(F.lit("no result"))).when(result & ~F.col("linked"), F.array(F.lit("no call"))).otherwise(none),
    )
    made = made.select("conv_id", "turn", "role", "kind", "call_id", "linked", F.array_join(said, "; ").alias("errors"), "made.json", "place", "rid")
    # positions: rows sorted over all partitions, and running sums of how many of a conversation the partitions before hold
    keys = ["conv_id", "place", "turn", "rid"]
    in_order = materialize(made.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id()))
    in_order = in_order.withColumn("part", F.shiftright("at", 33)).withColumn("conv", F.struct("conv_id"))
    runs = in_order.groupBy("conv", "part").agg(F.min("at").alias("begin"), F.count("*").alias("n"))
    before = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("conv", "part", "begin", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    placed_rows = in_order.join(runs, ["conv", "part"]).withColumn("position", F.col("base") + F.col("at") - F.col("begin"))
    discard(rows)
    return placed_rows.select("conv_id", "turn", "role", "kind", "call_id", "linked", "errors", "position", "json")


#: The tool that every request of a dialogue calls, in the query over plain conversations.
REPLY = {"reply": {"type": "object", "required": ["text"], "properties": {"text": {"type": "string"}}, "additionalProperties": False}}


def dialogue_as_calls(conversations: DataFrame) -> DataFrame:
    """Plain dialogues as tool use: a user's turn calls `reply` with its text, the assistant's turn is the result of the call one turn
    earlier; all other roles are messages."""
    user, bot = F.col("role") == "user", F.col("role") == "assistant"
    asked = F.when(user, F.col("turn")).when(bot, F.col("turn") - 1)
    content = F.when(user, F.to_json(F.struct("text"))).otherwise(F.col("text"))
    return conversations.select("conv_id", "turn", "role", F.when(user, "call").when(bot, "result").otherwise("message").alias("kind"), F.concat(F.lit("turn"), asked).alias("call_id"), F.when(user, "reply").alias("name"), content.alias("content"))
