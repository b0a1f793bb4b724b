"""From evidence to disjoint resolved spans, within the row: no shuffle, whatever the detectors.

Evidence is an array of structs (start, end, provider, entity_type, score) beside the text. Rows of evidence from
elsewhere are brought into that form by ``collect_evidence``, which shuffles the evidence and never the texts of rows
without any.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import EVIDENCE, is_blank, let, literal, once, scan_sql
from ..plans.model import DEFAULT_TYPES, FALLBACK_TYPE, MAX_SPANS, TYPE_GRAMMAR, Options, Policy, Registry
from ..sources.detect import FAILURE, NO_EVIDENCE, Detector, failure_of

RESOLVED = f"struct<entity_type:string,start:int,end:int,reason:string,evidence:array<{EVIDENCE}>>"


def canonical_type(label: Column, registry: Registry, own: Mapping[str, Sequence[str]] | None = None, provider: Column | None = None) -> Column:
    """Alias, then the type if trusted (for everyone, or by this provider), else PII; malformed labels give null."""
    at = label
    if registry.aliases:
        at = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in sorted(registry.aliases.items()) for x in pair)), label), label)
    trusted = at.isin(sorted(registry.trusted or DEFAULT_TYPES))
    for name, types in sorted((own or {}).items()):
        if types and provider is not None:
            trusted = trusted | ((provider == name) & at.isin(sorted(types)))
    good = label.rlike(rf"\A{TYPE_GRAMMAR}\z") & (F.length(label) <= 128)
    return F.when(good & trusted, at).when(good, F.lit(FALLBACK_TYPE))


_BROKEN = rf"""r -> exists(r.es, x -> x is null or coalesce(x.start < 0 or x.`end` <= x.start or x.`end` > r.n or not x.score >= 0 or not x.score <= 1 or isnan(x.score)
  or not x.entity_type rlike {literal(rf"\A{TYPE_GRAMMAR}\z")} or length(x.entity_type) > 128, true))"""


def broken_range(text: Column, evidence: Column) -> Column:
    """Whether a span is null or reaches outside the text, or its label or score is malformed."""
    # most rows have no evidence; of the others the text is measured once, not once a span
    return evidence.isNull() | ((F.size(evidence) > 0) & let(F.struct(F.length(text).alias("n"), evidence.alias("es")), _BROKEN))


def accept(evidence: Column, options: Options, policy: Policy, registry: Registry, own: Mapping[str, Sequence[str]] | None = None) -> Column:
    """Evidence with canonical types that the allow-list and the score floors let through."""
    mapped = F.transform(evidence, lambda x: x.withField("entity_type", canonical_type(x["entity_type"], registry, own, x["provider"])))
    floor = lambda x: F.greatest(F.lit(options.minimum_score), F.coalesce(F.element_at(F.create_map(*(F.lit(v) for pair in sorted(policy.floors.items()) for v in pair)), x["provider"]), F.lit(0.0))) if policy.floors else F.lit(options.minimum_score)
    every = tuple(t for types in (own or {}).values() for t in types)
    allowed = options.allowed(registry, every)
    return F.filter(mapped, lambda x: (x["score"] >= floor(x)) & (x["entity_type"].isin(list(allowed)) if allowed else F.lit(True)))


def select_providers(evidence: Column, succeeded: Column, policy: Policy) -> Column:
    """evidence of the providers that the mode uses, given the ids of those that succeeded."""
    if policy.mode == "UNION":
        used = lambda p: F.array_contains(succeeded, p)
    elif policy.mode == "PRIMARY":
        used = lambda p: F.array_contains(succeeded, p) & p.isin(policy.primary, *policy.supplemental)
    else:
        main = F.array_contains(succeeded, F.lit(policy.primary))
        used = lambda p: F.array_contains(succeeded, p) & (~main | p.isin(policy.primary, *policy.supplemental))
    return F.filter(evidence, lambda x: used(x["provider"]))


def _clusters(fallback: str) -> str:
    """SQL lambda from ordered evidence to resolved spans. A cluster begins where a span starts at or after the end of all
    before it."""
    first = f"zip_with(transform(es, e -> e.start), {scan_sql('transform(es, e -> e.`end`)', -1, 'greatest({a}, {b})')}, (s, m) -> s >= m)"
    found = "slice(es, f + 1, coalesce(try_element_at(firsts, k + 2), size(es)) - f)"
    cluster = "named_struct('start', found[0].start, 'end', array_max(transform(found, e -> e.`end`)), 'kinds', array_distinct(transform(found, e -> e.entity_type)))"
    whole = "named_struct('n', size(exact), 'kinds', array_distinct(transform(exact, e -> e.entity_type)))"
    decided = f"""named_struct(
      'entity_type', case when size(x.kinds) = 1 then x.kinds[0] when size(c.kinds) = 1 then c.kinds[0] else {literal(fallback)} end, 'start', c.start, 'end', c.`end`,
      'reason', case when size(found) = 1 then 'SINGLE_EVIDENCE' when x.n = size(found) and size(c.kinds) = 1 then 'EXACT_MATCH' when x.n = size(found) then 'TYPE_CONFLICT'
        when size(x.kinds) = 1 then 'COVERING_EVIDENCE' when size(c.kinds) > 1 then 'TYPE_CONFLICT' else 'OVERLAP_UNION' end, 'evidence', found)"""
    exact = "filter(found, e -> e.start = c.start and e.`end` = c.`end`)"
    one = f"transform(array({found}), found -> transform(array({cluster}), c -> transform(array({exact}), exact -> transform(array({whole}), x -> {decided})[0])[0])[0])[0]"
    return f"es -> transform(array(filter(transform({first}, (o, i) -> case when o then i end), i -> i is not null)), firsts -> transform(firsts, (f, k) -> {one}))[0]"


def resolve(evidence: Column, fallback: str = FALLBACK_TYPE) -> Column:
    """Disjoint spans, in order. A span joins the cluster that it overlaps; touching ones stay apart."""
    order = F.array_sort(let(evidence, "es -> transform(es, e -> named_struct('start', e.start, 'end', e.`end`, 'provider', e.provider, 'entity_type', e.entity_type, 'score', e.score))"))
    return F.when(F.size(evidence) == 0, F.array().cast(f"array<{RESOLVED}>")).otherwise(let(order, _clusters(fallback)).cast(f"array<{RESOLVED}>"))


def outcome(failures: Column, succeeded: Column, policy: Policy) -> Column:
    """Failure struct of a row (null: go on) from its providers' failures and successes."""
    first = F.try_element_at(failures, F.lit(1))
    every = F.when((F.size(succeeded) == 0) & (F.size(failures) > 0), failure_of("", "ALL_ANALYZERS_FAILED"))
    if policy.failures == "REQUIRE_ALL":
        return F.when(F.size(failures) > 0, first)
    if policy.failures == "REQUIRE_PRIMARY":
        return F.coalesce(F.try_element_at(F.filter(failures, lambda f: f["provider"] == policy.primary), F.lit(1)), every)
    return every


def analyze(df: DataFrame, detectors: Sequence[Detector], text: str = "text", options: Options | None = None, policy: Policy | None = None, registry: Registry | None = None) -> DataFrame:
    """Adds ``spans`` (resolved), ``succeeded`` (provider ids), ``failures`` and ``failure`` to each row.

    R8: ``select_spans`` gives the plain view. E1, E4: all detectors of the first stage run; those of the second only
    on rows whose primary detector failed. Where ``failure`` isn't null, ``spans`` is null: nothing downstream can
    take the text for clean (E2, E3). Blank text: no spans, no detector asked (F4).
    """
    options, policy, registry = options or Options(), policy or Policy(), registry or Registry()
    first, second = policy.stages([d.provider for d in detectors])
    by = {d.provider: d for d in detectors}
    own = {d.provider: tuple(d.own_types) for d in detectors}
    names = {p: f"_found_{k}" for k, p in enumerate((*first, *second))}
    for p in first:
        df = by[p].detect(df, text, names[p])
    if second:
        main = F.col(names[policy.primary])["failure"].isNotNull() | broken_range(F.col(text), F.col(names[policy.primary])["evidence"])
        for p in second:
            df = by[p].detect(df, text, names[p], when=main)
    ran = lambda p: F.col(names[p]).isNotNull() & ~F.col("_blank")
    df = once(df, _blank=is_blank(F.col(text)), **{f"{n}_bad": broken_range(F.col(text), F.col(n)["evidence"]) for n in names.values()})
    states = {}
    for p, n in names.items():
        failed = F.when(ran(p), F.coalesce(F.col(n)["failure"], F.when(F.col(f"{n}_bad"), failure_of(p, "ANALYZER_CONTRACT_VIOLATION"))))
        states[f"{n}_failed"] = failed.cast(FAILURE)
    df = once(df, **states)
    here = lambda xs: F.filter(F.array(*xs), lambda x: x.isNotNull())
    good = {p: ran(p) & F.col(f"{n}_failed").isNull() for p, n in names.items()}
    df = once(
        df,
        _evidence=F.concat(*(F.when(good[p], F.col(n)["evidence"]).otherwise(F.array().cast(NO_EVIDENCE)) for p, n in names.items())),
        failures=here(F.col(f"{n}_failed") for n in names.values()).cast(f"array<{FAILURE}>"),
        succeeded=here(F.when(good[p], F.lit(p)) for p in names),
    )
    many = F.when(F.size("_evidence") > MAX_SPANS, failure_of("", "ANALYZER_CONTRACT_VIOLATION"))
    df = once(df, failure=F.coalesce(many, outcome(F.col("failures"), F.col("succeeded"), policy)).cast(FAILURE))
    chosen = accept(select_providers(F.col("_evidence"), F.col("succeeded"), policy), options, policy, registry, own)
    df = once(df, _accepted=F.when(F.col("failure").isNull(), chosen))
    df = once(df, spans=F.when(F.col("failure").isNull(), resolve(F.col("_accepted"), registry.resolve(policy.fallback_type))))
    return df.drop("_evidence", "_accepted", "_blank", *(f"{n}{x}" for n in names.values() for x in ("", "_bad", "_failed")))


def failure_events(df: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """What an observer of failures is told: keys, provider, code, phase, attempt_count of each failed provider; never
    a text. Watching changes nothing about the rows."""
    return df.select(*keys, F.explode("failures").alias("f")).select(*keys, "f.provider", "f.code", "f.phase", "f.attempt_count")


def select_spans(df: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """A row for each resolved span: keys, entity_type, start, end, reason, evidence."""
    return df.select(*keys, F.explode("spans").alias("s")).select(*keys, "s.entity_type", "s.start", "s.end", "s.reason", "s.evidence")


def collect_evidence(texts: DataFrame, evidence: DataFrame, key: str = "doc_id", out: str = "supplied") -> DataFrame:
    """Texts with a column of the rows of ``evidence`` (key, entity_type, start, end, score) that belong to them."""
    arrays = evidence.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), "entity_type", F.col("score").cast("double").alias("score")))).alias(out))
    return texts.join(arrays, key, "left")
