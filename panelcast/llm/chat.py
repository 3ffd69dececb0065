"""Chat formatting: tool calls linked to results, in dependency order, checked and serialised; no Python on executors."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.llm.common import cut


@dataclass(frozen=True)
class Argument:
    """What a tool takes by a name: kind is string, integer, number, boolean, array or object."""

    kind: str
    required: bool = True
    least: float | None = None


#: Prefixes of the names that schema_of_variant gives each kind.
KINDS = {"string": ("STRING",), "integer": ("BIGINT",), "number": ("BIGINT", "DOUBLE", "DECIMAL"), "boolean": ("BOOLEAN",), "array": ("ARRAY",), "object": ("OBJECT",)}


def quoted(text: Column) -> Column:
    """text as a JSON string; null as null."""
    return F.when(text.isNull(), F.lit("null")).otherwise(F.regexp_replace(F.to_json(F.array(text)), r"(?s)^\[|\]$", ""))


def argument_errors(name: Column, arguments: Column, schemas: dict[str, dict[str, Argument]]) -> Column:
    """Comma-joined faults of a call's arguments (a JSON text), empty if they fit the tool's schema."""
    value = F.try_parse_json(arguments)
    is_object = F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False))
    faults = [F.when(F.coalesce(~name.isin(list(schemas)), F.lit(True)), F.lit("unknown_tool")), F.when(~is_object, F.lit("not_an_object"))]
    for tool, wanted in sorted(schemas.items()):
        for key, a in sorted(wanted.items()):
            found = F.try_variant_get(value, f"$.{key}", "variant")
            kind = F.schema_of_variant(found)
            fits = F.lit(False)
            for prefix in KINDS[a.kind]:
                fits = fits | kind.startswith(prefix)
            absent = found.isNull() | (kind == "VOID")
            fault = F.when(absent, F.lit(f"missing:{key}") if a.required else F.lit(None)).when(~fits, F.lit(f"type:{key}"))
            if a.least is not None:
                fault = fault.when(F.try_variant_get(value, f"$.{key}", "double") < a.least, F.lit(f"least:{key}"))
            faults.append(F.when((name == tool) & is_object, fault))
    return F.array_join(F.array_compact(F.array(*faults)), ",")


def levels(parents: DataFrame, max_rounds: int = 64) -> DataFrame:
    """node, parent (null: none) -> node, level: the number of its ancestors; null on and behind a cycle.

    Every round doubles the steps that each open node looks up, so a chain of n takes log2(n) rounds.
    """
    state = cut(parents.select("node", F.col("parent").alias("up"), F.when(F.col("parent").isNull(), 0).otherwise(1).cast("long").alias("steps")))
    n, rounds = state.where("up is not null").count(), 0
    while n and rounds < min(max_rounds, n.bit_length() + 1):
        above = state.select(F.col("node").alias("up"), F.col("up").alias("next"), F.col("steps").alias("more"))
        moved = state.where("up is not null").join(above.hint("shuffle_hash"), "up").select("node", F.col("next").alias("up"), (F.col("steps") + F.col("more")).alias("steps"))
        state = cut(state.where("up is null").unionByName(moved))
        rounds += 1
        if not state.where("up is not null").limit(1).count():
            break
    return state.select("node", F.when(F.col("up").isNull(), F.col("steps")).alias("level"))


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: dict[str, dict[str, Argument]]) -> DataFrame:
    """call_id, conv_id, turn, level, status, errors, n_calls, n_results, json for each call identifier.

    calls: conv_id, call_id, turn, name, arguments (JSON text), parent_id, the call whose result it uses;
    results: conv_id, call_id, turn, content. Both are reduced by identifier, the first by turn and then
    by content standing for repeats, and hash-joined on it. status is linked, pending (no result), early
    (result before call), orphan (no call) or cycle. level counts the calls that must come before: by
    level, turn and call_id the calls are in topological order. A parent that doesn't exist counts as
    none. json is canonical: keys sorted, no spaces. Null identifiers link nothing and are left out;
    other columns are ignored; empty tables give no rows.
    """
    first = F.min(F.struct("turn", "conv_id", "name", "arguments", "parent_id")).alias("c")
    own = cut(calls.where("call_id is not null").groupBy("call_id").agg(first, F.count("*").alias("n_calls")))
    answers = results.where("call_id is not null").groupBy("call_id").agg(F.min(F.struct("turn", "conv_id", "content")).alias("r"), F.count("*").alias("n_results"))
    known = own.select(F.col("call_id").alias("parent"))
    asked = own.select(F.col("call_id").alias("node"), F.col("c.parent_id").alias("parent"))
    parents = asked.where("parent is not null").join(known.hint("shuffle_hash"), "parent").select("node", "parent").unionByName(asked.join(known.hint("shuffle_hash"), "parent", "left_anti").select("node", F.lit(None).cast("string").alias("parent")))
    both = own.join(answers.hint("shuffle_hash"), "call_id", "full").join(levels(parents).withColumnRenamed("node", "call_id").hint("shuffle_hash"), "call_id", "left")
    c, r = F.col("c"), F.col("r")
    status = F.when(c.isNull(), "orphan").when(F.col("level").isNull(), "cycle").when(r.isNull(), "pending").when(r["turn"] < c["turn"], "early").otherwise("linked")
    parsed = F.to_json(F.try_parse_json(c["arguments"]))
    json = F.concat(F.lit('{"arguments":'), F.coalesce(parsed, quoted(c["arguments"])), F.lit(',"call_id":'), quoted(F.col("call_id")), F.lit(',"content":'), quoted(r["content"]), F.lit(',"name":'), quoted(c["name"]), F.lit("}"))
    return both.select(
        "call_id",
        F.coalesce(c["conv_id"], r["conv_id"]).alias("conv_id"),
        F.coalesce(c["turn"], r["turn"]).alias("turn"),
        "level",
        status.alias("status"),
        F.when(c.isNotNull(), argument_errors(c["name"], c["arguments"], schemas)).alias("errors"),
        F.coalesce("n_calls", F.lit(0)).cast("long").alias("n_calls"),
        F.coalesce("n_results", F.lit(0)).cast("long").alias("n_results"),
        json.alias("json"),
    )


REPLY = {"reply": {"prompt": Argument("string"), "turn": Argument("integer", least=0), "words": Argument("integer", required=False, least=1)}}


def turns_as_calls(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of plain conversations: a user's turn calls reply, building on the user's turn two
    before; an assistant's turn is the result of the turn before it. Other roles are neither."""
    name = lambda turn: F.concat_ws("-", F.when(F.col("conv_id").isNotNull() & F.col("turn").isNotNull(), F.col("conv_id").cast("string")), turn.cast("string"))
    usable = conversations.where("conv_id is not null and turn is not null")
    words = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    arguments = F.concat(F.lit('{"words":'), words.cast("string"), F.lit(',"turn":'), F.col("turn").cast("string"), F.lit(',"prompt":'), quoted(F.col("text")), F.lit("}"))
    calls = usable.where("role = 'user'").select("conv_id", name(F.col("turn")).alias("call_id"), "turn", F.lit("reply").alias("name"), arguments.alias("arguments"), name(F.col("turn") - 2).alias("parent_id"))
    results = usable.where("role = 'assistant'").select("conv_id", name(F.col("turn") - 1).alias("call_id"), "turn", F.col("text").alias("content"))
    return calls, results


LINKED_TURNS_SQL = r"""
WITH calls AS (
  SELECT conv_id, turn, text, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words FROM conversations WHERE role = 'user'),
first_call AS (SELECT conv_id, turn, min(struct_pack(t := text, w := words)) AS c, count(*) AS n_calls FROM calls GROUP BY ALL),
first_result AS (SELECT conv_id, turn - 1 AS turn, min(text) AS content, count(*) AS n_results FROM conversations WHERE role = 'assistant' GROUP BY ALL),
runs AS (SELECT *, turn // 2 - row_number() OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn) AS run FROM first_call),
leveled AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn % 2, run ORDER BY turn) - 1 AS level FROM runs)
SELECT coalesce(c.conv_id, r.conv_id) || '-' || coalesce(c.turn, r.turn) AS call_id, coalesce(c.conv_id, r.conv_id) AS conv_id,
  CASE WHEN c.conv_id IS NULL THEN r.turn + 1 ELSE c.turn END AS turn, level,
  CASE WHEN c.conv_id IS NULL THEN 'orphan' WHEN r.conv_id IS NULL THEN 'pending' ELSE 'linked' END AS status,
  CASE WHEN c.conv_id IS NOT NULL THEN concat_ws(',', CASE WHEN c.c.t IS NULL THEN 'missing:prompt' END, CASE WHEN c.turn < 0 THEN 'least:turn' END, CASE WHEN c.c.w < 1 THEN 'least:words' END) END AS errors,
  coalesce(n_calls, 0) AS n_calls, coalesce(n_results, 0) AS n_results,
  CASE WHEN c.conv_id IS NOT NULL THEN '{"arguments":{"prompt":' || coalesce(CAST(to_json(c.c.t) AS VARCHAR), 'null') || ',"turn":' || c.turn || ',"words":' || c.c.w || '},"call_id":"' || c.conv_id || '-' || c.turn || '","content":' || coalesce(CAST(to_json(r.content) AS VARCHAR), 'null') || ',"name":"reply"}' END AS json
FROM leveled c FULL JOIN first_result r ON c.conv_id = r.conv_id AND c.turn = r.turn
"""
