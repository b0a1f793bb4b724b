"""Chat formatting: tool calls and results are joined by identifier, ordered, checked and written as canonical JSON.

Calls and results are pre-aggregated by identifier (so repeats never multiply), hash-joined, and each call gets its
depth in the dependency order: 0 if it depends on no known call, else one more than the deepest call it depends on.
Chains of calls with one dependency are jumped over by pointer doubling, in as many rounds as the logarithm of the
longest; calls with several are then settled level by level. Each round is written to the shared folder. Arguments are checked against schemas compiled into
expressions over the parsed value. Canonical JSON has sorted keys, no white space and each string escaped one way
(the text form of a parsed variant). All of it is built-in functions.

Defined cases: arguments that aren't a JSON object, or hold a key twice, are invalid (``json``), as is a missing,
unknown or ill-typed argument (the reason names it). An identifier called more than once is ``duplicate_call``; a
result without call ``orphan``; a call without result ``pending``; calls on a cycle ``cyclic`` (depth null).
A call may depend on any number of calls; unknown ones don't count. Arguments beyond the size limit of the variant
type (128 MB) count as no JSON, and a message beyond it is null; texts below are formatted whole.
Null conv_id or turn: no identifier, the row is a plain message. Null text: a call without its prompt (invalid), an
empty result. Repeated rows are formatted each; empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil, log2

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, read_table


@dataclass(frozen=True)
class Argument:
    """One property of a call's arguments: a JSON type and bounds (lengths of strings, values of numbers)."""

    name: str
    kind: str  # string, integer, number, boolean, object, array
    required: bool = True
    least: int | None = None
    most: int | None = None


#: Types of a parsed value by JSON schema type.
_KINDS = {"string": "^STRING$", "integer": "^BIGINT$", "number": "^(BIGINT|DECIMAL.*|DOUBLE)$", "boolean": "^BOOLEAN$", "object": "^OBJECT<", "array": "^ARRAY<"}


def faults(arguments: Column, schema: tuple[Argument, ...]) -> Column:
    """array<string> of what is wrong with a JSON text under a schema; empty if nothing is."""
    value = F.try_parse_json(arguments)
    is_object = F.coalesce(F.schema_of_variant(value).rlike("^OBJECT<"), F.lit(False))
    found = [F.when(~is_object, F.lit("json"))]
    for a in schema:
        one = F.try_variant_get(value, f"$['{a.name}']", "variant")
        kind = F.schema_of_variant(one)
        there = kind.isNotNull() & (kind != "VOID")
        if a.required:
            found.append(F.when(is_object & ~F.coalesce(there, F.lit(False)), F.lit(f"missing:{a.name}")))
        found.append(F.when(there & ~kind.rlike(_KINDS[a.kind]), F.lit(f"type:{a.name}")))
        size = F.length(F.try_variant_get(value, f"$['{a.name}']", "string")) if a.kind == "string" else F.try_variant_get(value, f"$['{a.name}']", "double")
        fits = there & kind.rlike(_KINDS[a.kind])
        if a.least is not None:
            found.append(F.when(fits & (size < a.least), F.lit(f"least:{a.name}")))
        if a.most is not None:
            found.append(F.when(fits & (size > a.most), F.lit(f"most:{a.name}")))
    known = F.array(*(F.lit(a.name) for a in schema))
    unknown = F.array_except(F.json_object_keys(arguments), known)
    found.append(F.when(is_object & (F.size(unknown) > 0), F.concat(F.lit("unknown:"), F.array_join(F.array_sort(unknown), "+"))))
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def canonical(json: Column) -> Column:
    """The canonical form of a JSON text, null if it isn't valid."""
    return F.to_json(F.try_parse_json(json))


def depths(calls: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct (call_id) and edges (call_id, parent_id) -> (call_id, depth); null depth: on, or behind, a cycle."""
    known = calls.select(F.col("call_id").alias("parent_id"))
    edges = materialize(edges.where("call_id is not null and parent_id is not null").distinct().join(known, "parent_id", "left_semi").select("call_id", "parent_id"), "op5-edges")
    one = edges.groupBy("call_id").agg(F.count("*").alias("n"), F.min("parent_id").alias("parent_id"))
    # up: where the chain of single dependencies leads; null for its end, a call with none or with several
    at = calls.select("call_id").join(one, "call_id", "left").select("call_id", F.when(F.col("n") == 1, F.col("parent_id")).alias("up"), F.when(F.col("n") == 1, 1).otherwise(0).cast("long").alias("far"), F.coalesce("n", F.lit(0)).alias("n"))
    at = materialize(at, "op5-depth")
    for _ in range(ceil(log2(max(2, at.count()))) + 1):
        to = at.where("up is not null").select(F.col("call_id").alias("up"), F.col("up").alias("next"), F.col("far").alias("more"))
        moving = at.join(to, "up", "left").select("call_id", F.coalesce("next", "up").alias("up"), (F.col("far") + F.coalesce("more", F.lit(0))).alias("far"), "n", F.col("next").isNotNull().alias("moved"))
        moving = materialize(moving, "op5-depth")
        at = moving.drop("moved")
        if moving.where("moved").isEmpty():
            break
    # a call on a cycle leads to another single one for ever, so it never reaches an end
    ends = at.where("up is null").select(F.col("call_id").alias("up"))
    ending = at.join(ends, "up", "left_semi").select("call_id", "up", "far").unionByName(at.where("up is null").select("call_id", F.col("call_id").alias("up"), "far"))
    done = at.where("up is null and n = 0").select(F.col("call_id").alias("up"), F.lit(0).cast("long").alias("base"))
    several = at.where("n > 1").select("call_id")
    if not several.isEmpty():
        done, ending = materialize(done, "op5-done"), materialize(ending, "op5-ending")
        steps = edges.join(several, "call_id", "left_semi").join(ending.select(F.col("call_id").alias("parent_id"), "up", "far"), "parent_id", "left").select("call_id", "up", "far")
        steps = materialize(steps, "op5-steps")
        while True:
            met = steps.join(done, "up", "left").groupBy("call_id").agg(F.max(F.col("base") + F.col("far") + 1).alias("base"), F.bool_and(F.col("base").isNotNull()).alias("whole"))
            more = materialize(met.where("whole").select(F.col("call_id").alias("up"), "base").join(done.select("up"), "up", "left_anti"), "op5-level")
            if more.isEmpty():
                break
            done = materialize(done.unionByName(more), "op5-done")
    deep = ending.join(done, "up").select("call_id", (F.col("base") + F.col("far")).alias("depth"))
    return calls.select("call_id").join(deep, "call_id", "left")


def link(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Calls (call_id, parent_id, a row for each dependency of a call) and results (call_id) -> a row for each identifier:
    n_calls (rows of its most frequent dependency), n_results, depth."""
    rows = calls.where("call_id is not null").groupBy("call_id", "parent_id").agg(F.count("*").alias("n"))
    rows = materialize(rows, "op5-calls")
    called = rows.groupBy("call_id").agg(F.max("n").alias("n_calls"))
    answered = results.where("call_id is not null").groupBy("call_id").agg(F.count("*").alias("n_results"))
    both = called.join(depths(called.select("call_id"), rows.select("call_id", "parent_id")), "call_id").join(answered.hint("shuffle_hash"), "call_id", "full_outer")
    return both.select("call_id", F.coalesce("n_calls", F.lit(0)).alias("n_calls"), F.coalesce("n_results", F.lit(0)).alias("n_results"), "depth")


#: A user's turn is a call of the assistant, its answer the next turn.
REPLY = (Argument("prompt", "string", least=1), Argument("turn", "integer", least=0))


def format_turns(conversations: DataFrame, schema: tuple[Argument, ...] = REPLY) -> DataFrame:
    """conv_id, turn, role, call_id, depth, n_calls, n_results, status and message (canonical JSON) of each turn."""
    name = lambda turn: F.concat_ws(":", F.col("conv_id").cast("string"), turn.cast("string"))
    known = F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    turns = conversations.select("conv_id", "turn", "role", "text").withColumn(
        "call_id", F.when(known & (F.col("role") == "user"), name(F.col("turn"))).when(known & (F.col("role") == "assistant"), name(F.col("turn") - 1))
    )
    turns = turns.withColumn("parent_id", F.when((F.col("role") == "user") & (F.col("turn") >= 2), name(F.col("turn") - 2)))
    links = link(turns.where("role = 'user'").select("call_id", "parent_id"), turns.where("role = 'assistant'").select("call_id"))
    arguments = F.to_json(F.struct(F.col("text").alias("prompt"), F.col("turn").alias("turn")))
    whole = turns.join(links, "call_id", "left").withColumn("arguments", F.when(F.col("role") == "user", arguments))
    is_call, is_result = (F.col("call_id").isNotNull() & (F.col("role") == r) for r in ("user", "assistant"))
    whole = whole.withColumn("faults", F.when(is_call, faults(F.col("arguments"), schema)))
    status = (
        F.when(is_call & (F.size("faults") > 0), F.concat(F.lit("invalid "), F.array_join("faults", ",")))
        .when(is_call & (F.col("n_calls") > 1), "duplicate_call")
        .when(is_call & F.col("depth").isNull(), "cyclic")
        .when(is_call & (F.col("n_results") == 0), "pending")
        .when(is_result & (F.col("n_calls") == 0), "orphan")
        .when(is_call | is_result, "linked")
        .otherwise("message")
    )
    as_call = F.to_json(F.struct(F.try_parse_json("arguments").alias("arguments"), F.when(F.col("depth") > 0, F.col("parent_id")).alias("depends_on"), F.col("call_id").alias("id"), F.lit("reply").alias("name"), F.lit("tool_call").alias("type")))
    as_result = F.to_json(F.struct(F.coalesce("text", F.lit("")).alias("content"), F.col("call_id").alias("id"), F.lit("tool_result").alias("type")))
    as_message = F.to_json(F.struct(F.coalesce("text", F.lit("")).alias("content"), F.col("role").alias("role"), F.lit("message").alias("type")))
    message = F.when(is_call, as_call).when(is_result, as_result).otherwise(as_message)
    return whole.select("conv_id", "turn", "role", "call_id", F.when(is_call, F.col("depth")).alias("depth"), F.coalesce("n_calls", F.lit(0)).alias("n_calls"), F.coalesce("n_results", F.lit(0)).alias("n_results"), status.alias("status"), canonical(message).alias("message"))


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_turns(read_table(spark, sf_dir, "conversations"))


_SQL = """
WITH RECURSIVE t AS (
  SELECT conv_id, turn, role, text, CASE WHEN conv_id IS NULL OR turn IS NULL THEN NULL WHEN role = 'user' THEN conv_id || ':' || turn WHEN role = 'assistant' THEN conv_id || ':' || (turn - 1) END AS call_id
  FROM conversations),
c AS (SELECT call_id, count(*) AS n_calls, min(CASE WHEN turn >= 2 THEN conv_id || ':' || (turn - 2) END) AS parent_id FROM t WHERE role = 'user' AND call_id IS NOT NULL GROUP BY 1),
r AS (SELECT call_id, count(*) AS n_results FROM t WHERE role = 'assistant' AND call_id IS NOT NULL GROUP BY 1),
d AS (SELECT call_id, 0::BIGINT AS depth FROM c WHERE parent_id IS NULL OR parent_id NOT IN (SELECT call_id FROM c)
      UNION ALL SELECT c.call_id, d.depth + 1 FROM c JOIN d ON c.parent_id = d.call_id),
j AS (SELECT t.*, coalesce(n_calls, 0)::BIGINT AS n_calls, coalesce(n_results, 0)::BIGINT AS n_results, depth, parent_id,
        role = 'user' AND call_id IS NOT NULL AS is_call, role = 'assistant' AND call_id IS NOT NULL AS is_result
      FROM t LEFT JOIN c USING (call_id) LEFT JOIN r USING (call_id) LEFT JOIN d USING (call_id))
SELECT conv_id, turn, role, call_id, CASE WHEN is_call THEN depth END::BIGINT AS depth, n_calls, n_results,
  CASE WHEN is_call AND text IS NULL THEN 'invalid missing:prompt' WHEN is_call AND length(text) < 1 THEN 'invalid least:prompt'
    WHEN is_call AND n_calls > 1 THEN 'duplicate_call' WHEN is_call AND depth IS NULL THEN 'cyclic' WHEN is_call AND n_results = 0 THEN 'pending'
    WHEN is_result AND n_calls = 0 THEN 'orphan' WHEN is_call OR is_result THEN 'linked' ELSE 'message' END AS status,
  CASE WHEN is_call THEN '{"arguments":{' || CASE WHEN text IS NULL THEN '' ELSE '"prompt":' || to_json(text)::VARCHAR || ',' END || '"turn":' || turn || '}' || CASE WHEN depth > 0 THEN ',"depends_on":' || to_json(parent_id)::VARCHAR ELSE '' END || ',"id":' || to_json(call_id)::VARCHAR || ',"name":"reply","type":"tool_call"}'
    WHEN is_result THEN '{"content":' || to_json(coalesce(text, ''))::VARCHAR || ',"id":' || to_json(call_id)::VARCHAR || ',"type":"tool_result"}'
    ELSE '{"content":' || to_json(coalesce(text, ''))::VARCHAR || CASE WHEN role IS NULL THEN '' ELSE ',"role":' || to_json(role)::VARCHAR END || ',"type":"message"}' END AS message
FROM j"""

QUERIES = {"op5_chat": op5_chat}
ORACLE = {"op5_chat": _SQL}
