"""Boundary operators: output policies, disclosure to tools, messages, guards and events."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.storage import materialize
from ..plans.model import BOUNDARIES, OUTCOMES, ConfigError, Disclosures, OutputPolicy
from ..sources.detect import Detector
from .jsonval import protect_json, restore_json
from .resolve import analyze
from .rewrite import allowed_vault, apply_puts, contains_pii, detokenize, redact, token_ranges, tokenize

#: Roles of messages, and metadata keys that hold a provider's reasoning.
ROLES = ("user", "system", "assistant", "tool")
REASONING_KEYS = ("reasoningContent", "thinking")


def apply_output_policy(df: DataFrame, policy: OutputPolicy | str, session: str | None = None, key: str | None = None, vault: DataFrame | None = None, text: str = "text", strict: bool = False) -> DataFrame:
    """Adds ``output`` and ``blocked`` to analysed rows. Null text passes; BLOCK empties what holds personal data
    (or raises, if ``strict``); a failed analysis blocks."""
    policy = policy if isinstance(policy, OutputPolicy) else OutputPolicy(True, policy)
    no = F.lit(False)
    if not policy.enabled:
        return df.withColumns({"output": F.col(text), "blocked": no})
    if policy.action == "BLOCK":
        hit = F.col(text).isNotNull() & contains_pii(F.col("spans"))
        empty = F.raise_error(F.lit(policy.block_message)).cast("string") if strict else F.lit("")
        return df.withColumns({"output": F.when(hit, empty).otherwise(F.col(text)), "blocked": hit})
    done = redact(df, text, out="output") if policy.action == "REDACT" else tokenize(df, vault, session, key, text, out="output")
    return done.withColumn("blocked", F.col(text).isNotNull() & F.col("output").isNull())


def protect_return_direct(df: DataFrame, vault: DataFrame, session: str, key: str, direct: str, detectors: Sequence[Detector], policy: OutputPolicy, text: str = "text") -> DataFrame:
    """Where ``direct`` is true, known tokens become originals before the policy is applied."""
    restored = detokenize(df, vault, session, key, text, "_restored")
    chosen = restored.withColumn(text, F.when(F.col(direct), F.col("_restored")).otherwise(F.col(text))).drop("_restored")
    return apply_output_policy(analyze(chosen, detectors, text), policy, session, key, vault, text)


def disclose(df: DataFrame, vault: DataFrame, policy: Disclosures, session: str, key: str, tool: str = "tool_name", text: str = "tokenized", out: str = "disclosed") -> DataFrame:
    """Each row's tool sees the originals of the types it is allowed, by exact name; others see none.
    ``changed`` says whether anything was disclosed."""
    rows = policy.rows()
    spark = df.sparkSession
    allowed = spark.createDataFrame(rows, "_tool string, entity_type string")
    scoped = vault.join(F.broadcast(allowed), "entity_type")  # as many rows as the policy has pairs
    named = df.withColumn("_who", F.concat_ws("|", F.length(F.col(key).cast("string")).cast("string"), F.col(key).cast("string"), F.col(tool)))
    at = token_ranges(named.withColumn("_tool", F.col(tool)), session, "_who", text, ["_tool"])
    hits = at.join(scoped.select("session_id", "token", "_tool", F.col("original").alias("put")), ["session_id", "token", "_tool"])
    return apply_puts(named, hits, "_who", session, text, out).drop("_who").withColumn("changed", ~F.col(out).eqNullSafe(F.col(text)))


def call_tool(calls: DataFrame, vault: DataFrame, tool: Callable[[DataFrame], DataFrame], types: Sequence[str], detectors: Sequence[Detector], session: str, key: str, arguments: str = "arguments", order: Sequence[str] = (), **settings) -> tuple[DataFrame, DataFrame | None]:
    """Arguments (strict JSON) with the allowed types disclosed go to ``tool`` (adds ``result``); its results are
    protected again. A null result is TOOL_EXECUTION_FAILED."""
    opened = restore_json(calls, vault, key, session, arguments, "input", list(types)).drop("mode")
    opened = opened.withColumn("failure_code", F.coalesce("failure_code", F.when(F.try_parse_json(F.col(arguments)).isNull(), "TRANSFORMATION_CONFLICT")))
    done = tool(opened.withColumn("input", F.when(F.col("failure_code").isNull(), F.col("input"))))
    done = done.withColumn("_input_failure", F.coalesce("failure_code", F.when(F.col("result").isNull(), "TOOL_EXECUTION_FAILED"))).drop("failure_code")
    done = materialize(done, "tool-results")  # a tool is asked once, whatever is read of its answers
    closed, made = protect_json(done, key, detectors, "TOKENIZE", "result", session, order or [key], out="protected", **settings)
    return closed.withColumn("failure_code", F.coalesce("_input_failure", "failure_code")).drop("_input_failure"), made


def transform_messages(messages: DataFrame, key: str, session: str, order: Sequence[str], detectors: Sequence[Detector], **settings) -> tuple[DataFrame, DataFrame | None]:
    """Text of each message, as JSON or plain text; an unknown role is a failure and loses its text."""
    known = messages.where(F.col("role").isin(*ROLES))
    other = messages.where(~F.coalesce(F.col("role").isin(*ROLES), F.lit(False)))
    done, vault = protect_json(known, key, detectors, "TOKENIZE", "text", session, order, out="protected", **settings)
    refused = other.withColumns({"protected": F.lit(None).cast("string"), "mode": F.lit(None).cast("string"), "failure_code": F.lit("TRANSFORMATION_CONFLICT")})
    return done.unionByName(refused), vault


def transform_reasoning(metadata: Column, change: Callable[[Column], Column]) -> Column:
    """Values of the reasoning keys are changed like text; all others stay."""
    return F.transform_values(metadata, lambda k, v: F.when(k.isin(*REASONING_KEYS), change(v)).otherwise(v))


def guard_controls(df: DataFrame, detectors: Sequence[Detector], fields: Sequence[str], key: str) -> DataFrame:
    """Fields that steer a model are never rewritten: personal data in one is a failure. Adds ``rejected`` (names)."""
    flags = []
    for name in fields:
        df = analyze(df, detectors, name).withColumn(f"_bad_{name}", contains_pii(F.col("spans"))).drop("spans", "failures", "failure", "succeeded")
        flags.append(F.when(F.col(f"_bad_{name}"), F.lit(name)))
    return df.withColumn("rejected", F.filter(F.array(*flags), lambda x: x.isNotNull())).drop(*(f"_bad_{n}" for n in fields))


def unregistered(calls: DataFrame, tools: DataFrame, name: str = "tool_name") -> DataFrame:
    """Calls of tools that aren't registered."""
    return calls.join(tools.select(name).distinct(), name, "left_anti")


def duplicate_tools(*snapshots: DataFrame | None, name: str = "tool_name") -> DataFrame:
    """Names that the joined snapshots of all providers hold twice; a missing snapshot is an error."""
    if any(s is None for s in snapshots) or not snapshots:
        raise ConfigError("TOOL_PROVIDER_UNAVAILABLE")
    every = snapshots[0].select(name)
    for s in snapshots[1:]:
        every = every.unionByName(s.select(name))
    return every.groupBy(name).agg(F.count("*").alias("n")).where("n > 1")


def foreign_tools(tools: DataFrame, service: str, name: str = "tool_name", owner: str = "service_id") -> DataFrame:
    """P10: tools that no wrapper, or another service's, stands before; they must not be called. Adds ``reason``."""
    reason = F.when(F.col(owner).isNull(), "UNWRAPPED").when(F.col(owner) != service, "OTHER_SERVICE")
    return tools.withColumn("reason", reason).where("reason is not null").select(name, owner, "reason")


def fingerprint(fields: Sequence[str]) -> Column:
    """Digest of a tool's definition; null fields count as values."""
    return F.sha2(F.to_json(F.array(*(F.struct(F.col(f).isNull().alias("none"), F.col(f).cast("string").alias("value")) for f in fields))), 256)


def changed_tools(before: DataFrame, after: DataFrame, fields: Sequence[str] = ("description", "schema"), name: str = "tool_name") -> DataFrame:
    """(name, change) of the tools whose definition isn't the same at both boundaries: ADDED, REMOVED or CHANGED."""
    one = lambda df, as_: df.select(name, fingerprint(fields).alias(as_))
    both = one(before, "_was").join(one(after, "_is"), name, "full_outer")
    change = F.when(F.col("_was").isNull(), "ADDED").when(F.col("_is").isNull(), "REMOVED").when(F.col("_was") != F.col("_is"), "CHANGED")
    return both.select(name, change.alias("change")).where("change is not null")


def incomplete_tools(tools: DataFrame, fields: Sequence[str] = ("tool_name", "description", "schema")) -> DataFrame:
    """Definitions that lack a field."""
    missing = F.filter(F.array(*(F.when(F.col(f).isNull(), F.lit(f)) for f in fields)), lambda x: x.isNotNull())
    return tools.withColumn("missing", missing).where(F.size("missing") > 0)


def all_tool_calls(messages: DataFrame, key: str, in_message: str = "tool_calls", in_metadata: str = "metadata_tool_calls") -> DataFrame:
    """Calls of a message and of its metadata, each with its source."""
    one = lambda c, s: messages.select(key, F.explode(c).alias("call"), F.lit(s).alias("source"))
    return one(in_message, "message").unionByName(one(in_metadata, "metadata"))


def strip_internal(df: DataFrame, internal: Sequence[str] = ("session_id", "spans", "succeeded", "failures", "failure", "vault")) -> DataFrame:
    """What an application or a tool gets to see."""
    return df.drop(*internal, *(c for c in df.columns if c.startswith("_")))


def events(df: DataFrame, boundary: str, before: str, after: str, blocked: str | None = None, disclosed: bool = False) -> DataFrame:
    """(boundary, outcome) of each row whose text changed or was blocked; never a payload."""
    if boundary not in BOUNDARIES:
        raise ConfigError("unknown boundary")
    changed = ~F.col(before).eqNullSafe(F.col(after))
    kind = F.when(F.col(blocked) if blocked else F.lit(False), OUTCOMES[2]).when(changed, OUTCOMES[1] if disclosed else OUTCOMES[0])
    return df.select(F.lit(boundary).alias("boundary"), kind.alias("outcome")).where("outcome is not null")


def bundle(*, input_guard: bool, model_guard: bool, lifecycle: int, output: Sequence[OutputPolicy] = (), limits: Sequence = ()) -> tuple:
    """A pipeline has both guards, one lifecycle, at most one output policy, and limits that agree."""
    if not (input_guard and model_guard) or lifecycle != 1 or len(output) > 1:
        raise ConfigError("incomplete or doubled pipeline")
    if len(set(limits)) > 1:
        raise ConfigError("inspection limits conflict")
    return (output[0] if output else OutputPolicy(), limits[0] if limits else None)


def scoped_view(vault: DataFrame, policy: Disclosures, tool_name: str) -> DataFrame:
    """What one tool may see of a vault."""
    return allowed_vault(vault, sorted(policy.by_tool.get(tool_name, ())))
