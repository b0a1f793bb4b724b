"""The queries of the catalogue and their DuckDB SQL."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.storage import spread
from .operators import evaluate, jsonval, policy, resolve, rewrite
from .plans import sql
from .plans.model import Disclosures, InspectionLimits, Options, OutputPolicy, Policy, Registry, typo_limit
from .plans.rules import CARDS, NAMES, NUMBERS, OVERLAPPING, SAFE
from .sources.detect import GazetteerDetector, RegexDetector, SuppliedDetector, http_failure_column
from .streaming import frames as fr

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
RULES = RegexDetector(SAFE)
MORE = RegexDetector(OVERLAPPING, "EXTRA")
REGISTRY = Registry(aliases={"EMPLOYEE": "STAFF", "STAFF": "PERSON"})


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))


def analyzed(spark: SparkSession, sf_dir: str, *detectors, **settings) -> DataFrame:
    return resolve.analyze(documents(spark, sf_dir), detectors or (RULES,), **settings)


def values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def sql_values(name: str, columns: str, rows: list[tuple]) -> str:
    cell = lambda v: "NULL" if v is None else sql.text_literal(v) if isinstance(v, str) else str(v)
    return f"{name}({columns}) AS (VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)})"


EV = f"ev AS ({sql.evidence(SAFE)})"
BOTH = f"ev AS ({sql.evidence(SAFE)} UNION ALL {sql.evidence(OVERLAPPING, 'EXTRA')})"
MAPPED = "(SELECT * REPLACE (CASE WHEN entity_type = 'EMPLOYEE' THEN 'PERSON' ELSE entity_type END AS entity_type) FROM ev)"
WITH_EV, WITH_BOTH = f"WITH {EV}, {sql.resolved('ev')}", f"WITH {BOTH}, {sql.resolved(MAPPED)}"
TOKEN_RE = r"\[\[PII_[A-Z0-9]+(?:_[A-Z0-9]+)*_[a-f0-9]{32}_[1-9][0-9]*\]\]"
OCCURRENCES = """occ AS (SELECT doc_id, source AS session_id, entity_type, 'text' AS value_kind, substr(text, "start" + 1, "end" - "start") AS original, "start", "end" FROM resolved JOIN documents USING (doc_id))"""
WITH_VAULT = f"{WITH_EV}, {OCCURRENCES}, {sql.vault('occ', 'doc_id, start')}"
WITH_TOKENS = f"""{WITH_VAULT}, placed AS (SELECT doc_id, "start", "end", token FROM occ JOIN vault USING (session_id, entity_type, value_kind, original)), {sql.rewritten('tok', 'token', 'placed')}"""


# --- detection -------------------------------------------------------------------------------------------------


@query(f'WITH {EV} SELECT doc_id, entity_type, "start", "end", length(value) AS len FROM ev')
def evidence_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D1, D2, D6."""
    found = RULES.detect(documents(spark, sf_dir), "text", "found").select("doc_id", F.explode("found.evidence").alias("e"))
    return found.select("doc_id", "e.entity_type", "e.start", "e.end", (F.col("e.end") - F.col("e.start")).alias("len"))


LUHN_SQL = "list_sum(list_transform(range(1, length(value) + 1), lambda i: CASE WHEN (length(value) - i) % 2 = 1 THEN CASE WHEN substr(value, i, 1)::INT * 2 > 9 THEN substr(value, i, 1)::INT * 2 - 9 ELSE substr(value, i, 1)::INT * 2 END ELSE substr(value, i, 1)::INT END)) % 10 = 0"


@query(f'WITH ev AS ({sql.evidence(CARDS)}) SELECT doc_id, "start", value FROM ev WHERE {LUHN_SQL}')
def evidence_validated_luhn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D4."""
    found = RegexDetector(CARDS).detect(documents(spark, sf_dir), "text", "found").select("doc_id", "text", F.explode("found.evidence").alias("e"))
    return found.select("doc_id", "e.start", F.substring("text", F.col("e.start") + 1, F.col("e.end") - F.col("e.start")).alias("value"))


@query(r"SELECT doc_id, unnest(regexp_extract_all(text, '\+1 \(([0-9]{3})\)', 1)) AS value FROM documents")
def evidence_capture_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D3: the area code of a telephone number, by a rule with a group."""
    from .plans.model import RegexRule

    area = RegexDetector([RegexRule("LOCATION", r"\+1 \(([0-9]{3})\)", 0.8, capture_group=1)])
    found = area.detect(documents(spark, sf_dir), "text", "found").select("text", "doc_id", F.explode("found.evidence").alias("e"))
    return found.select("doc_id", F.substring("text", F.col("e.start") + 1, F.col("e.end") - F.col("e.start")).alias("value"))


WORDS = ["stupid", "trash", "idiot"]


@query(f"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9_]+')) AS word FROM documents)
SELECT doc_id, 'PERSON' AS entity_type, count(*) AS n FROM w WHERE word IN ({', '.join(map(sql.text_literal, WORDS))}) GROUP BY doc_id""")
def evidence_gazetteer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D14."""
    found = GazetteerDetector(dict.fromkeys(WORDS, "PERSON")).detect(documents(spark, sf_dir), "text", "found").select("doc_id", F.explode("found.evidence").alias("e"))
    return found.groupBy("doc_id", F.col("e.entity_type").alias("entity_type")).agg(F.count("*").alias("n"))


@query("WITH s AS (SELECT event_id % 500 + 100 AS status FROM events) SELECT status::INTEGER AS status, CASE WHEN status IN (401, 403) THEN 'ANALYZER_AUTHENTICATION_FAILED' WHEN status = 408 THEN 'ANALYZER_TIMEOUT' WHEN status = 429 THEN 'ANALYZER_RATE_LIMITED' WHEN status >= 500 THEN 'ANALYZER_UNAVAILABLE' ELSE 'ANALYZER_EXECUTION_FAILED' END AS code, (status IN (408, 429) OR status >= 500) AS retryable, count(*) AS n FROM s GROUP BY ALL")
def http_status_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event's number stands for a status."""
    status = table(spark, sf_dir, "events").select((F.col("event_id") % 500 + 100).cast("int").alias("status"))
    code, again = http_failure_column(F.col("status"))
    return status.groupBy("status", code.alias("code"), again.alias("retryable")).agg(F.count("*").alias("n"))



SUPPLIED = r"""SELECT doc_id, 'EXTERNAL' AS provider, entity_type, "start", "end", score FROM (
  SELECT doc_id, entity_type, "start", "end", score, CASE WHEN regexp_matches(text, '[^ \t\n\x0b\f\r]') THEN length(text) END AS n FROM documents, (VALUES ('PERSON', 0, 4, 0.9), ('ODD_LABEL', 6, 9, 0.5), ('PERSON', 3, 7, 0.2)) AS v(entity_type, "start", "end", score)) WHERE n >= 9"""


@query(f"""WITH ev AS (SELECT * REPLACE (CASE WHEN entity_type = 'ODD_LABEL' THEN 'PII' ELSE entity_type END AS entity_type) FROM ({SUPPLIED}) WHERE score >= 0.4), {sql.resolved('ev')}
SELECT doc_id, "start", "end", entity_type, reason FROM resolved""")
def supplied_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans from the caller, under the global floor only; a text that one of them leaves fails."""
    docs = documents(spark, sf_dir)
    spans = [("PERSON", 0, 4, 0.9), ("ODD_LABEL", 6, 9, 0.5), ("PERSON", 3, 7, 0.2)]
    given = docs.withColumn("given", F.array(*(F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(t).alias("entity_type"), F.lit(s).alias("score")) for t, a, b, s in spans)))
    done = resolve.analyze(given, [SuppliedDetector("given")], options=Options(minimum_score=0.4))
    return resolve.select_spans(done).select("doc_id", "start", "end", "entity_type", "reason")


# --- canonical types and filters -------------------------------------------------------------------------------


@query(f"WITH {BOTH} SELECT CASE WHEN entity_type = 'EMPLOYEE' THEN 'PERSON' ELSE entity_type END AS entity_type, provider, count(*) AS n FROM ev GROUP BY ALL")
def canonicalize_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C1-C3."""
    docs = MORE.detect(RULES.detect(documents(spark, sf_dir), "text", "a"), "text", "b")
    rows = docs.select(F.explode(F.concat("a.evidence", "b.evidence")).alias("e")).select("e.*")
    own = {d.provider: d.own_types for d in (RULES, MORE)}
    return rows.groupBy(resolve.canonical_type(F.col("entity_type"), REGISTRY, own, F.col("provider")).alias("entity_type"), "provider").agg(F.count("*").alias("n"))


LABELS = [("PER", "X"), ("STAFF_NAME", "X"), ("person", "X"), ("GEO", "X"), ("GEO", "Y"), ("BAD__TYPE", "X"), ("EMAIL_ADDRESS", "Y"), ("TICKET_1", "Y")]


def _picked(spark: SparkSession, sf_dir: str, rows: list[tuple], *columns: str) -> DataFrame:
    """A row of ``rows`` for each event, by its number."""
    given = F.array(*(F.struct(*(F.lit(v).alias(c) for c, v in zip(columns, r, strict=True))) for r in rows))
    return table(spark, sf_dir, "events").select(F.element_at(given, (F.col("event_id") % len(rows) + 1).cast("int")).alias("r")).select("r.*")


def _picked_sql(columns: str, rows: list[tuple]) -> str:
    numbered = [(k, *r) for k, r in enumerate(rows)]
    return f"{sql_values('given', 'k, ' + columns, numbered)}, v AS (SELECT {columns} FROM events JOIN given ON event_id % {len(rows)} = k)"


@query(f"""WITH {_picked_sql('label, provider', LABELS)}
SELECT label, provider, CASE WHEN NOT regexp_full_match(label, '[A-Z0-9]+(_[A-Z0-9]+)*') THEN NULL WHEN label IN ('PER', 'STAFF_NAME') THEN 'PERSON' WHEN label = 'EMAIL_ADDRESS' OR (label = 'GEO' AND provider = 'X') THEN label ELSE 'PII' END AS entity_type, count(*) AS n FROM v GROUP BY ALL""")
def canonicalize_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Malformed labels, chains of aliases, and types that one provider alone is trusted for; a label for each event."""
    registry = Registry(aliases={"PER": "PERSON", "STAFF_NAME": "PER"})
    rows = _picked(spark, sf_dir, LABELS, "label", "provider")
    return rows.groupBy("label", "provider", resolve.canonical_type(F.col("label"), registry, {"X": ("GEO",)}, F.col("provider")).alias("entity_type")).agg(F.count("*").alias("n"))



@query(f"""WITH {EV}, k AS (SELECT * FROM ev WHERE entity_type IN ('EMAIL_ADDRESS', 'CREDIT_CARD', 'PHONE_NUMBER') AND score >= 0.95) SELECT doc_id, entity_type, count(*) AS n FROM k GROUP BY ALL""")
def filter_allowlist_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1, F2, C4: an allow-list, and the higher of the global and the provider's floor."""
    options = Options(included=("EMAIL_ADDRESS", "CREDIT_CARD", "PHONE_NUMBER"), minimum_score=0.5)
    done = analyzed(spark, sf_dir, options=options, policy=Policy(floors={"regex": 0.95}))
    return resolve.select_spans(done).groupBy("doc_id", "entity_type").agg(F.count("*").alias("n"))


def _by_mode(mode: Policy) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        # the primary provider is down for every third document
        docs = documents(spark, sf_dir)
        found = MORE.detect(RULES.detect(docs, "text", "a"), "text", "b")
        up = F.coalesce(F.col("doc_id") % 3 != 0, F.lit(True))
        good = F.when(up, F.array(F.lit("REGEX"), F.lit("EXTRA"))).otherwise(F.array(F.lit("EXTRA")))
        chosen = resolve.select_providers(F.concat("a.evidence", "b.evidence"), good, mode)
        return found.select("doc_id", F.size(chosen).alias("n")).where("n > 0")

    return run


_MODES = {
    "provider_mode_union": (Policy(failures="ALLOW_PARTIAL"), "provider = 'EXTRA' OR doc_id % 3 <> 0"),
    "provider_mode_primary": (Policy("PRIMARY", "REGEX", failures="ALLOW_PARTIAL"), "provider = 'REGEX' AND doc_id % 3 <> 0"),
    "provider_mode_fallback": (Policy("PRIMARY_WITH_FALLBACK", "REGEX", failures="ALLOW_PARTIAL"), "(provider = 'REGEX') = (doc_id % 3 <> 0)"),
}
for _name, (_mode, _where) in _MODES.items():  # F3, E4
    QUERIES[_name] = _by_mode(_mode)
    ORACLE[_name] = f"WITH {BOTH} SELECT doc_id, count(*)::INTEGER AS n FROM ev WHERE {_where} GROUP BY doc_id"


# --- resolution ------------------------------------------------------------------------------------------------


def _both(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.select_spans(analyzed(spark, sf_dir, RULES, MORE, registry=REGISTRY))


@query(f'{WITH_BOTH} SELECT doc_id, "start", "end", entity_type FROM resolved')
def resolve_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R1-R4, R8."""
    return _both(spark, sf_dir).select("doc_id", "start", "end", "entity_type")


@query(f"{WITH_BOTH} SELECT reason, count(*) AS n FROM resolved GROUP BY reason")
def resolve_reason_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R5."""
    return _both(spark, sf_dir).groupBy("reason").agg(F.count("*").alias("n"))


@query(f'{WITH_BOTH} SELECT doc_id, "start", "end", n::INTEGER AS n_evidence, np::INTEGER AS n_providers FROM resolved')
def resolve_evidence_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R6."""
    providers = F.array_distinct(F.transform("evidence", lambda x: x["provider"]))
    return _both(spark, sf_dir).select("doc_id", "start", "end", F.size("evidence").alias("n_evidence"), F.size(providers).alias("n_providers"))


# --- rewriting -------------------------------------------------------------------------------------------------


@query(f"""{WITH_BOTH}, {sql.rewritten('red', "'[REDACTED_' || entity_type || ']'", 'resolved')} SELECT doc_id, out AS redacted FROM red""")
def redact_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T2, T8."""
    return rewrite.redact(analyzed(spark, sf_dir, RULES, MORE, registry=REGISTRY)).select("doc_id", "redacted")


@query(f"""{WITH_EV}, {sql.rewritten('red', "'[REDACTED_' || entity_type || ']'", 'resolved')}, t AS (SELECT doc_id, lang, entity_type, "end" - "start" AS n FROM resolved JOIN documents USING (doc_id))
SELECT lang, entity_type, count(*) AS n_spans, count(DISTINCT doc_id) AS n_docs, sum(n)::BIGINT AS n_chars FROM t GROUP BY ALL""")
def protected_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: what was found and replaced, by language and type."""
    done = rewrite.redact(analyzed(spark, sf_dir)).where("redacted is not null").select("doc_id", "lang", F.explode("spans").alias("s"))
    return done.groupBy("lang", F.col("s.entity_type").alias("entity_type")).agg(F.count("*").alias("n_spans"), F.countDistinct("doc_id").alias("n_docs"), F.sum(F.col("s.end") - F.col("s.start")).alias("n_chars"))


def _tokenized(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return rewrite.analyze_and_tokenize(documents(spark, sf_dir), [RULES], "source", "doc_id", ["doc_id"], nonce=F.md5)  # so that SQL can tell the tokens


@query(f"{WITH_TOKENS} SELECT doc_id, out AS tokenized FROM tok")
def tokenize_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S1-S4, T1, T9."""
    return _tokenized(spark, sf_dir)[0].select("doc_id", "tokenized")


@query(f"{WITH_VAULT} SELECT session_id, entity_type, token_index, token, original FROM vault")
def vault(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S1-S4."""
    return _tokenized(spark, sf_dir)[1].select("session_id", "entity_type", "token_index", "token", "original")


@query(f"""{WITH_TOKENS}, open AS (SELECT doc_id, unnest(regexp_extract_all(out, '{TOKEN_RE}')) AS token FROM tok)
SELECT doc_id, text AS restored, count(vault.token) AS n_tokens FROM documents LEFT JOIN open USING (doc_id) LEFT JOIN vault ON vault.token = open.token AND vault.session_id = documents.source GROUP BY doc_id, text""")
def detokenize_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T3."""
    rows, made = _tokenized(spark, sf_dir)
    back = rewrite.detokenize(rows, made, "source", "doc_id", "tokenized")
    return back.select("doc_id", "restored", F.size(F.regexp_extract_all("tokenized", F.lit(rewrite.TOKEN), F.lit(0))).cast("long").alias("n_tokens"))


DISCLOSED = {"mailer": frozenset({"EMAIL_ADDRESS"}), "dialer": frozenset({"PHONE_NUMBER", "IP_ADDRESS"})}
TOOLS = [("mailer",), ("dialer",), ("printer",)]


@query(f"""{WITH_TOKENS}, tools(tool_name) AS (VALUES ('mailer'), ('dialer'), ('printer')), pol(tool_name, entity_type) AS (VALUES ('mailer', 'EMAIL_ADDRESS'), ('dialer', 'PHONE_NUMBER'), ('dialer', 'IP_ADDRESS')),
seen AS (SELECT doc_id || ':' || tool_name AS k, doc_id, tool_name, occ."start", occ."end", CASE WHEN pol.entity_type IS NULL THEN token ELSE original END AS put, pol.entity_type IS NOT NULL AS open
  FROM occ JOIN vault USING (session_id, entity_type, value_kind, original) CROSS JOIN tools LEFT JOIN pol USING (tool_name, entity_type)),
texts AS (SELECT doc_id || ':' || tool_name AS k, doc_id, tool_name, text FROM documents JOIN (SELECT DISTINCT doc_id FROM occ) USING (doc_id) CROSS JOIN tools),
{sql.rewritten('dis', 'put', 'seen', 'texts', 'k')}
SELECT doc_id, tool_name, out AS disclosed, EXISTS (SELECT 1 FROM seen WHERE seen.k = dis.k AND open) AS changed FROM dis JOIN texts USING (k)""")
def detokenize_scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each tool sees the types it is allowed."""
    rows, made = _tokenized(spark, sf_dir)
    calls = rows.where("tokenized <> text").withColumn("tool_name", F.explode(F.array(*(F.lit(t) for (t,) in TOOLS)))).withColumn("call_id", F.concat_ws(":", F.col("doc_id").cast("string"), "tool_name"))
    return policy.disclose(calls.select("doc_id", "source", "tool_name", "call_id", "tokenized"), made, Disclosures(DISCLOSED), "source", "call_id").select("doc_id", "tool_name", "disclosed", "changed")


@query(f"{WITH_TOKENS} SELECT doc_id, out AS restored FROM tok")
def foreign_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Another session's tokens are just text."""
    rows, made = _tokenized(spark, sf_dir)
    back = rewrite.detokenize(rows.withColumn("other", F.concat("source", F.lit("-other"))), made, "other", "doc_id", "tokenized")
    return back.select("doc_id", "restored")


_KNOWN_TEXT = "CASE WHEN doc_id % 2 = 0 THEN out || ' bob@x.org' ELSE out END"


@query(f"""{WITH_TOKENS}, mixed AS (SELECT doc_id, {_KNOWN_TEXT} AS text FROM tok WHERE doc_id IN (SELECT doc_id FROM occ)),
wide AS (SELECT doc_id, 'PERSON' AS entity_type, 0 AS "start", length(text)::INTEGER AS "end" FROM mixed),
k AS ({sql.evidence([type(SAFE[0])('PERSON', TOKEN_RE)], table='mixed')}),
e AS (SELECT doc_id, "end" AS a, lead("start") OVER (PARTITION BY doc_id ORDER BY "start") AS b FROM k UNION ALL SELECT doc_id, 0, min("start") FROM k GROUP BY doc_id)
SELECT e.doc_id, a AS "start", coalesce(b, wide."end") AS "end" FROM e JOIN wide USING (doc_id) WHERE a < coalesce(b, wide."end")""")
def exclude_known_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T4, T5: a span over a whole text keeps what isn't one of the session's tokens."""
    rows, made = _tokenized(spark, sf_dir)
    mixed = rows.where("tokenized <> text").select("doc_id", "source", F.when(F.col("doc_id") % 2 == 0, F.concat("tokenized", F.lit(" bob@x.org"))).otherwise(F.col("tokenized")).alias("text"))
    wide = mixed.withColumn("spans", F.array(F.struct(F.lit(0).alias("start"), F.length("text").alias("end"), F.lit("PERSON").alias("entity_type"))))
    left = rewrite.exclude_known_tokens(wide, made, "source", "doc_id")
    return left.select("doc_id", F.explode("spans").alias("s")).select("doc_id", "s.start", "s.end")


@query(f"{WITH_EV} SELECT doc_id, EXISTS (SELECT 1 FROM resolved r WHERE r.doc_id = d.doc_id) AS has_pii FROM documents d")
def contains_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T6."""
    return analyzed(spark, sf_dir).select("doc_id", rewrite.contains_pii(F.col("spans")).alias("has_pii"))


@query(f"""{WITH_EV}, n AS (SELECT doc_id, sum(11 + length(entity_type) - ("end" - "start")) AS more FROM resolved GROUP BY doc_id) SELECT doc_id, coalesce(length(text) + coalesce(more, 0) > 2000, false) AS over FROM documents LEFT JOIN n USING (doc_id)""")
def output_limit_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T7, with a small limit; a null text isn't over it."""
    return rewrite.redact(analyzed(spark, sf_dir), limit=2000).select("doc_id", (F.col("text").isNotNull() & F.col("redacted").isNull()).alias("over"))


# --- structured values -----------------------------------------------------------------------------------------


@query("""SELECT event_id, CASE WHEN regexp_matches(json_extract_string(props, '$.k'), '6[0-9]') THEN regexp_replace(props, '[0-9]+', '"[REDACTED_NATIONAL_ID]"') ELSE props END AS props FROM events""")
def json_props_protect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers inside JSON; what isn't personal stays byte for byte."""
    rows = spread(table(spark, sf_dir, "events").select("event_id", "props"))
    done, _ = jsonval.protect_json(rows, "event_id", [RegexDetector(NUMBERS)], "REDACT", "props", out="protected")
    return done.select("event_id", F.col("protected").alias("props"))


_DOUBLED = "CASE event_id % 3 WHEN 0 THEN '{\"x\": {\"k\": ' || (event_id % 100) || ', \"k\": 2}}' WHEN 1 THEN '{\"a\": ' || (event_id % 100) || ', \"b\": 1e3, \"c\": 1.10}' ELSE 'no json ' || (event_id % 100) || ' here' END"


@query(f"""WITH v AS (SELECT event_id, {_DOUBLED} AS payload, event_id % 100 BETWEEN 60 AND 69 AS hit FROM events)
SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'TRANSFORMATION_CONFLICT' END AS failure_code,
CASE event_id % 3 WHEN 1 THEN CASE WHEN hit THEN regexp_replace(payload, '6[0-9]', '"[REDACTED_NATIONAL_ID]"') ELSE payload END WHEN 2 THEN regexp_replace(payload, '6[0-9]', '[REDACTED_NATIONAL_ID]') END AS protected FROM v""")
def json_duplicate_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A name that stands twice in an object, untouched lexemes, and what isn't JSON."""
    rows = table(spark, sf_dir, "events").select("event_id", F.expr(_DOUBLED).alias("payload"))
    done, _ = jsonval.protect_json(rows, "event_id", [RegexDetector(NUMBERS)], "REDACT", "payload", out="protected")
    return done.select("event_id", "failure_code", "protected")


_NUMBERS = """n AS (SELECT event_id, user_id, props, nullif(regexp_extract(props, '6[0-9]'), '') IS NOT NULL AS hit, regexp_extract(props, '-?[0-9]+') AS value FROM events),
f AS (SELECT user_id, value, min(event_id) AS first FROM n WHERE hit GROUP BY ALL), v AS (SELECT *, '[[PII_NATIONAL_ID_' || md5(user_id::VARCHAR) || '_' || row_number() OVER (PARTITION BY user_id ORDER BY first) || ']]' AS token FROM f)"""


@query(f"""WITH {_NUMBERS} SELECT event_id, CASE WHEN hit THEN '{{"k": "' || token || '"}}' ELSE props END AS protected, props AS restored FROM n LEFT JOIN v USING (user_id, value)""")
def json_tokens_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers become tokens and then the same numbers again."""
    rows = spread(table(spark, sf_dir, "events").select("event_id", "user_id", "props"))
    done, made = jsonval.protect_json(rows, "event_id", [RegexDetector(NUMBERS)], "TOKENIZE", "props", "user_id", ["event_id"], out="protected", nonce=F.md5)
    back = jsonval.restore_json(done.drop("failure_code", "mode"), made, "event_id", "user_id", "protected")
    return back.select("event_id", "protected", "restored")


# --- policies --------------------------------------------------------------------------------------------------


@query(f"""{WITH_EV}, d AS (SELECT doc_id, doc_id IN (SELECT doc_id FROM resolved) AS hit FROM documents)
SELECT action, (action = 'BLOCK' AND hit) AS blocked, hit AND action <> 'BLOCK' AS changed, count(*) AS n FROM d, (VALUES ('TOKENIZE'), ('REDACT'), ('BLOCK')) AS a(action) GROUP BY ALL""")
def output_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P1, P2."""
    rows = analyzed(spark, sf_dir)
    made = rewrite.build_vault(rewrite.found_values(rewrite.found_spans(rows, "source", "doc_id", ["doc_id"])), nonce=F.md5)
    parts = [policy.apply_output_policy(rows, OutputPolicy(True, a), "source", "doc_id", made).select(F.lit(a).alias("action"), "blocked", (~F.col("output").eqNullSafe(F.col("text")) & ~F.col("blocked")).alias("changed")) for a in ("TOKENIZE", "REDACT", "BLOCK")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("action", "blocked", "changed").agg(F.count("*").alias("n"))


_MSG = f"""msg AS (SELECT conv_id || ':' || turn AS k, conv_id, turn, role, text FROM conversations), ev AS ({sql.evidence(NAMES, table='msg', key='k')}), {sql.resolved('ev', 'k')},
occ AS (SELECT k, conv_id, turn, conv_id::VARCHAR AS session_id, entity_type, 'text' AS value_kind, substr(text, "start" + 1, "end" - "start") AS original, "start", "end" FROM resolved JOIN msg USING (k)), {sql.vault('occ', 'turn, start')},
placed AS (SELECT k, "start", "end", token FROM occ JOIN vault USING (session_id, entity_type, value_kind, original)), {sql.rewritten('tok', 'token', 'placed', 'msg', 'k')}"""


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spread(table(spark, sf_dir, "conversations")).withColumn("k", F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")))
    return policy.transform_messages(rows, "k", "conv_id", ["turn"], [RegexDetector(NAMES)], nonce=F.md5)[0]


@query(f"WITH {_MSG} SELECT conv_id, turn, role, out AS protected FROM tok JOIN msg USING (k)")
def messages_protect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P6, J10."""
    return _messages(spark, sf_dir).select("conv_id", "turn", "role", "protected")


@query(f"WITH {_MSG} SELECT role, count(*) AS n, count(*) FILTER (out <> text) AS n_changed FROM tok JOIN msg USING (k) GROUP BY role")
def messages_by_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P6."""
    return _messages(spark, sf_dir).groupBy("role").agg(F.count("*").alias("n"), F.count_if(F.col("protected") != F.col("text")).alias("n_changed"))


@query("WITH reg(event_type) AS (VALUES ('click'), ('view')) SELECT event_type, count(*) AS n FROM events WHERE event_type NOT IN (SELECT event_type FROM reg) GROUP BY event_type")
def toolcall_unregistered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P9."""
    tools = values(spark, [("click",), ("view",)], "event_type string")
    return policy.unregistered(table(spark, sf_dir, "events"), tools, "event_type").groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT conv_id AS response_id, turn AS id FROM conversations WHERE turn % 6 = 0 INTERSECT SELECT conv_id, turn FROM conversations")
def toolcall_cross_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls that stand in a message and in its metadata."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("response_id"), F.col("turn").alias("id"))
    told = rows.where("id % 2 = 0").withColumn("source", F.lit("message")).unionByName(rows.where("id % 3 = 0").withColumn("source", F.lit("metadata")))
    return fr.doubled_calls(told)


@query("SELECT tool_name, count(*) AS n FROM (SELECT p_name AS tool_name FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT p_name FROM part WHERE p_partkey % 5 = 0) GROUP BY tool_name HAVING count(*) > 1")
def toolcall_duplicate_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that two providers' tools have in common, or that one has twice."""
    tools = table(spark, sf_dir, "part").withColumnRenamed("p_name", "tool_name")
    return policy.duplicate_tools(tools.where("p_partkey % 3 = 0"), tools.where("p_partkey % 5 = 0"))


_GUARDED = "p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'call 10.0.0.1' ELSE p_name END AS name, CASE WHEN p_partkey % 3 = 0 THEN 'finds bob@x.org' ELSE p_type END AS description"


@query("SELECT p_partkey, concat_ws(',', CASE WHEN p_partkey % 4 = 0 THEN 'name' END, CASE WHEN p_partkey % 3 = 0 THEN 'description' END) AS rejected FROM part")
def control_field_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in a tool's name or description."""
    rows = table(spark, sf_dir, "part").selectExpr(*_GUARDED.split(", "))
    return policy.guard_controls(rows, [RULES], ["name", "description"], "p_partkey").select("p_partkey", F.array_join("rejected", ",").alias("rejected"))


@query(f"""{WITH_EV}, d AS (SELECT doc_id, doc_id IN (SELECT doc_id FROM resolved) AS hit FROM documents)
SELECT 'MODEL' AS boundary, 'PROTECTED' AS outcome, count(*) AS n FROM d WHERE hit UNION ALL SELECT 'APPLICATION_OUTPUT', 'BLOCKED', count(*) FROM d WHERE hit""")
def enforcement_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P14."""
    rows = analyzed(spark, sf_dir)
    model = policy.events(rewrite.redact(rows), "MODEL", "text", "redacted")
    out = policy.events(policy.apply_output_policy(rows, "BLOCK"), "APPLICATION_OUTPUT", "text", "output", "blocked")
    return model.unionByName(out).groupBy("boundary", "outcome").agg(F.count("*").alias("n"))


# --- failures --------------------------------------------------------------------------------------------------

STATUS = "(CASE WHEN doc_id % 5 = 0 THEN 'REGEX' WHEN doc_id % 5 = 1 THEN 'EXTRA' WHEN doc_id % 5 = 2 THEN 'BOTH' ELSE '' END)"


@query(f"""WITH s AS (SELECT doc_id, {STATUS} AS down FROM documents)
SELECT policy, CASE WHEN down = '' THEN 'OK' WHEN policy = 'REQUIRE_ALL' THEN 'ANALYZER_TIMEOUT' WHEN policy = 'REQUIRE_PRIMARY' THEN CASE WHEN down IN ('REGEX', 'BOTH') THEN 'ANALYZER_TIMEOUT' ELSE 'OK' END WHEN down = 'BOTH' THEN 'ALL_ANALYZERS_FAILED' ELSE 'OK' END AS outcome, count(*) AS n
FROM s, (VALUES ('REQUIRE_ALL'), ('REQUIRE_PRIMARY'), ('ALLOW_PARTIAL')) AS p(policy) GROUP BY ALL""")
def failure_policy_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E1-E3."""
    from .sources.detect import failure_of

    docs = documents(spark, sf_dir).select("doc_id", F.expr(STATUS).alias("down"))
    part = lambda p: F.col("down").isin(p, "BOTH")
    keep = lambda xs: F.filter(F.array(*xs), lambda x: x.isNotNull())
    fails = keep([F.when(part(p), failure_of(p, "ANALYZER_TIMEOUT")) for p in ("REGEX", "EXTRA")])
    good = keep([F.when(~part(p), F.lit(p)) for p in ("REGEX", "EXTRA")])
    rows = [docs.select(F.lit(name).alias("policy"), F.coalesce(resolve.outcome(fails, good, Policy(primary="REGEX", failures=name))["code"], F.lit("OK")).alias("outcome")) for name in ("REQUIRE_ALL", "REQUIRE_PRIMARY", "ALLOW_PARTIAL")]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).groupBy("policy", "outcome").agg(F.count("*").alias("n"))


KEYS = ["mode", "language", "minimum-score", "failure-policy", "primary-provider", "included-entity-types"]
TYPOS = [("mod",), ("mdoe",), ("langauge",), ("minimum-scores",), ("failurepolicy",), ("nothing-like-it",), ("primary-providers",)]


@query(f"""WITH {sql_values('k', 'name', [(k,) for k in KEYS])}, {_picked_sql('input', TYPOS)}, t AS (SELECT input, count(*) AS n_settings FROM v GROUP BY input),
d AS (SELECT input, name, levenshtein(input, name) AS dist FROM t, k), m AS (SELECT *, min(dist) OVER (PARTITION BY input) AS least FROM d),
b AS (SELECT input, min(name) AS name, count(*) AS n, min(dist) AS dist FROM m WHERE dist = least GROUP BY input)
SELECT input, CASE WHEN n = 1 AND dist <= CASE WHEN length(name) <= 4 THEN 1 WHEN length(name) <= 8 THEN 3 ELSE 4 END THEN name END AS suggestion, n_settings FROM b JOIN t USING (input)""")
def config_typo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G4, over a table of settings (as many candidate pairs as settings times known names)."""
    names = F.array(*(F.lit(k) for k in KEYS))
    rows = _picked(spark, sf_dir, TYPOS, "input").groupBy("input").agg(F.count("*").alias("n_settings"))
    near = F.array_sort(F.transform(names, lambda n: F.struct(F.levenshtein(F.col("input"), n).alias("distance"), n.alias("name"))))
    rows = rows.withColumn("near", near)
    first, second = F.col("near")[0], F.col("near")[1]
    limit = F.when(F.length(first["name"]) <= 4, typo_limit(4)).when(F.length(first["name"]) <= 8, typo_limit(8)).otherwise(typo_limit(9))
    return rows.select("input", F.when((first["distance"] < second["distance"]) & (first["distance"] <= limit), first["name"]).alias("suggestion"), "n_settings")


# --- streams ---------------------------------------------------------------------------------------------------


def _cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as frames of 100 characters."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    cut = docs.withColumn("frame_seq", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.length("text") / 100) - 1, F.lit(0)).cast("int"))))
    return cut.select(F.col("doc_id").cast("string").alias("response_id"), F.col("frame_seq").cast("long").alias("frame_seq"), F.lit(0).alias("position"), F.lit(None).cast("long").alias("choice_index"), F.lit("DEFAULT").alias("channel"), F.substring("text", F.col("frame_seq") * 100 + 1, F.lit(100)).alias("text"))


@query("SELECT doc_id::VARCHAR AS response_id, text FROM documents")
def stream_reassemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W1-W4."""
    return fr.join_text(fr.correlate(_cut(spark, sf_dir))).select("response_id", "text")


@query("SELECT doc_id::VARCHAR AS response_id, greatest(ceil(length(text) / 100.0) - 1, 0)::BIGINT AS frame_seq, text FROM documents")
def stream_last_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole text stands on the last frame only."""
    cut = fr.correlate(_cut(spark, sf_dir))
    return fr.replace_last(cut, fr.join_text(cut)).where("text is not null").select("response_id", "frame_seq", "text")


@query("""WITH f AS (SELECT user_id, event_id, count(*) OVER w AS n, sum(length(props)) OVER w AS chars FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT user_id, min(event_id) AS first_breach FROM f WHERE n > 40 OR chars > 300 GROUP BY user_id""")
def stream_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as frames of one response for each user."""
    frames = table(spark, sf_dir, "events").select("user_id", "event_id", F.col("props").alias("text"))
    return fr.first_breach(frames, InspectionLimits(max_frames=40, max_characters=300), "user_id", "event_id")


@query("""WITH g AS (SELECT user_id, epoch(ts) - epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) AS gap FROM events) SELECT user_id, count(*) FILTER (gap > 3600) AS gaps FROM g GROUP BY user_id""")
def stream_idle_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W9."""
    return fr.idle_gaps(table(spark, sf_dir, "events"), "user_id", "ts", 3600)


@query("""WITH c AS (SELECT DISTINCT conv_id, turn FROM conversations), l AS (SELECT conv_id, max(turn) AS most FROM c GROUP BY conv_id)
SELECT conv_id, CASE WHEN conv_id % 2 = 0 THEN string_agg(turn || ';', '' ORDER BY turn) ELSE repeat('ab', (most + 1)::INT) END AS merged FROM c JOIN l USING (conv_id) GROUP BY conv_id, most""")
def stream_merge_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fragments that repeat what came before (and now and then less of it), and fragments that go on."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn").distinct()
    part = F.when(F.col("conv_id") % 2 == 0, F.concat(F.col("turn").cast("string"), F.lit(";"))).otherwise(F.expr("repeat('ab', cast(turn + 1 as int))"))
    late = rows.where("conv_id % 2 = 1 and turn = 0").select("conv_id", F.lit(10_000).cast("long").alias("turn"), F.lit("ab").alias("part"))
    frames = rows.withColumn("part", part).unionByName(late)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("turn", "part"))), lambda x: x["part"])
    return frames.groupBy("conv_id").agg(fr.merge_fragments(ordered).alias("merged"))


# --- evaluation ------------------------------------------------------------------------------------------------


@query(f"""{WITH_BOTH}, want AS (SELECT doc_id, entity_type, value FROM ev WHERE provider = 'REGEX'), have AS (SELECT doc_id, entity_type, substr(text, "start" + 1, "end" - "start") AS value FROM resolved JOIN documents USING (doc_id))
SELECT (SELECT count(*) FROM (SELECT * FROM want INTERSECT ALL SELECT * FROM have)) AS tp, (SELECT count(*) FROM (SELECT * FROM have EXCEPT ALL SELECT * FROM want)) AS fp, (SELECT count(*) FROM (SELECT * FROM want EXCEPT ALL SELECT * FROM have)) AS fn""")
def evaluate_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V1: what one provider alone finds against what both, resolved, give."""
    want = RULES.detect(documents(spark, sf_dir), "text", "found").select("doc_id", "text", F.explode("found.evidence").alias("e"))
    want = want.select("doc_id", F.col("e.entity_type").alias("entity_type"), F.substring("text", F.col("e.start") + 1, F.col("e.end") - F.col("e.start")).alias("original"))
    have = analyzed(spark, sf_dir, RULES, MORE, registry=REGISTRY).select("doc_id", "text", F.explode("spans").alias("s"))
    have = have.select("doc_id", F.col("s.entity_type").alias("entity_type"), F.substring("text", F.col("s.start") + 1, F.col("s.end") - F.col("s.start")).alias("original"))
    return evaluate.score_detection(want, have)


@query(f"""{WITH_EV}, {sql.rewritten('red', "'[REDACTED_' || entity_type || ']'", 'resolved')}, o AS (SELECT DISTINCT doc_id, substr(text, "start" + 1, "end" - "start") AS original FROM resolved JOIN documents USING (doc_id))
SELECT count(*) AS leaks FROM red JOIN o USING (doc_id) WHERE contains(out, original)""")
def leak_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V3."""
    return evaluate.row_leaks(rewrite.redact(analyzed(spark, sf_dir)), "redacted").agg(F.count("*").alias("leaks"))


@query(f"{WITH_VAULT} SELECT doc_id, entity_type, count(DISTINCT token) AS n_tokens FROM occ JOIN vault USING (session_id, entity_type, value_kind, original) GROUP BY ALL")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V4, S3."""
    rows = _tokenized(spark, sf_dir)[0].select("doc_id", F.col("tokenized").alias("text"))
    return evaluate.token_counts(rows)


@query(f"""{WITH_EV}, {sql.rewritten('red', "'[REDACTED_' || entity_type || ']'", 'resolved')}, q AS (SELECT vec_id AS query_id, embedding AS e FROM embeddings WHERE vec_id % 100 = 0),
s AS (SELECT query_id, vec_id, list_dot_product(e::DOUBLE[], embedding::DOUBLE[]) / sqrt(list_dot_product(e::DOUBLE[], e::DOUBLE[]) * list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS score FROM q, embeddings),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS rank FROM s WHERE score >= 0.2)
SELECT query_id, vec_id, rank, round(score, 6) AS score, out AS protected FROM r LEFT JOIN red ON vec_id = doc_id WHERE rank <= 3""")
def rag_topk_protect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V8: what retrieval finds (the document of a vector's number) is redacted before it is given out."""
    vectors = table(spark, sf_dir, "embeddings")
    asked = vectors.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    found = evaluate.retrieve_protected(asked, vectors, documents(spark, sf_dir), [RULES], 3, 0.2)
    return found.select("query_id", "vec_id", "rank", F.round("score", 6).alias("score"), "protected")


# --- rows that share a key, or have none -----------------------------------------------------------------------

_ODD_KEYS = "CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 5 = 1 THEN 7 ELSE doc_id END"


@query(f"""{WITH_TOKENS} SELECT {_ODD_KEYS} AS k, out AS tokenized, count(*) AS n FROM tok JOIN documents USING (doc_id) GROUP BY ALL""")
def tokenize_repeated_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fifth of the rows has no key and another fifth the same one; each is protected all the same."""
    odd = documents(spark, sf_dir).withColumn("k", F.expr(_ODD_KEYS))
    rows, _ = rewrite.analyze_and_tokenize(odd, [RULES], "source", "k", ["doc_id"], nonce=F.md5)
    return rows.groupBy("k", "tokenized").agg(F.count("*").alias("n"))


@query("""SELECT CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id % 7 END AS k, CASE WHEN regexp_matches(json_extract_string(props, '$.k'), '6[0-9]') THEN regexp_replace(props, '[0-9]+', '"[REDACTED_NATIONAL_ID]"') ELSE props END AS props, count(*) AS n FROM events GROUP BY ALL""")
def json_repeated_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for payloads."""
    rows = spread(table(spark, sf_dir, "events")).select(F.when(F.col("event_id") % 3 != 0, F.col("event_id") % 7).alias("k"), "props")
    done, _ = jsonval.protect_json(rows, "k", [RegexDetector(NUMBERS)], "REDACT", "props", out="protected")
    return done.groupBy("k", F.col("protected").alias("props")).agg(F.count("*").alias("n"))


# --- detectors that run elsewhere ------------------------------------------------------------------------------


def _answers():
    """A remote service whose answers follow from the length of the text it is asked about."""
    asked: dict[str, int] = {}

    def send(url, body, headers, timeout):
        import json

        text = json.loads(body)["text"]
        asked[text] = asked.get(text, 0) + 1
        span = json.dumps([{"entity_type": "PERSON", "start": 0, "end": min(4, len(text)), "score": 0.9}]).encode()
        kind = len(text) % 9
        if kind == 0:
            return 503, b""
        if kind == 1:
            return 401, b""
        if kind == 2:
            return (429, b"") if asked[text] % 2 else (200, span)
        if kind == 3:
            return 200, b"[{}]"
        if kind == 4:
            return 200, span + b" " * 1_000
        if kind == 5:
            raise TimeoutError
        return 200, span

    return send


def _remote():
    from .plans.model import RemoteConfig
    from .sources.detect import remote_analyzer

    return remote_analyzer(RemoteConfig(max_response_bytes=1_000), send=_answers(), sleep=lambda s: None)()


_LIVE = "regexp_matches(coalesce(text, ''), '[^ \\t\\n\\x0b\\f\\r]')"


@query(f"""WITH d AS (SELECT doc_id, CASE WHEN {_LIVE} THEN length(text) % 9 ELSE 8 END AS kind FROM documents)
SELECT kind::INTEGER AS kind, CASE kind WHEN 0 THEN 'ANALYZER_UNAVAILABLE' WHEN 1 THEN 'ANALYZER_AUTHENTICATION_FAILED' WHEN 3 THEN 'ANALYZER_RESPONSE_INVALID' WHEN 4 THEN 'ANALYZER_RESPONSE_INVALID' WHEN 5 THEN 'ANALYZER_TIMEOUT' END AS code,
CASE WHEN kind IN (0, 5) THEN 2 WHEN kind IN (1, 3, 4) THEN 1 END AS attempts, count(*) AS n FROM d GROUP BY ALL""")
def remote_detector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retries, refusals, answers that are malformed or too long, timeouts."""
    from .sources.detect import FunctionDetector

    done = resolve.analyze(documents(spark, sf_dir), [FunctionDetector(_remote, "REMOTE")])
    kind = F.when(F.coalesce(F.col("text"), F.lit("")).rlike("[^ \\t\\n\\x0b\\f\\r]"), F.length("text") % 9).otherwise(8)
    return done.groupBy(kind.alias("kind"), F.col("failure.code").alias("code"), F.col("failure.attempt_count").alias("attempts")).agg(F.count("*").alias("n"))


def _moody():
    from .sources.detect import AnalyzerFailed

    def analyze(text):
        kind = len(text) % 6
        if kind == 0:
            raise RuntimeError(text)
        if kind == 1:
            raise AnalyzerFailed("ANALYZER_RATE_LIMITED", 3)
        if kind == 2:
            raise InterruptedError
        return [("PERSON", 0, len(text) + (kind == 3), 0.5)]

    return analyze


@query(f"""WITH d AS (SELECT length(text) % 6 AS kind FROM documents WHERE {_LIVE})
SELECT 'MOODY' AS provider, CASE kind WHEN 0 THEN 'ANALYZER_EXECUTION_FAILED' WHEN 1 THEN 'ANALYZER_RATE_LIMITED' WHEN 2 THEN 'ANALYSIS_INTERRUPTED' ELSE 'ANALYZER_CONTRACT_VIOLATION' END AS code, 'ANALYSIS' AS phase, CASE WHEN kind = 1 THEN 3 ELSE 1 END AS attempt_count, count(*) AS n FROM d WHERE kind < 4 GROUP BY ALL""")
def failure_observer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an observer is told of a detector that fails in every way, beside one that works."""
    from .sources.detect import FunctionDetector

    done = resolve.analyze(documents(spark, sf_dir), [RULES, FunctionDetector(_moody, "MOODY")], policy=Policy(failures="ALLOW_PARTIAL"))
    return resolve.failure_events(done).groupBy("provider", "code", "phase", "attempt_count").agg(F.count("*").alias("n"))


def _names():
    from .sources.detect import ner_analyzer

    known = {"PERSON": lambda words: [(k, k + 1, 0.9) for k, w in enumerate(words) if w in WORDS], "LOCATION": lambda words: [(k, k + 2, 0.6) for k in range(len(words) - 1) if words[k] == "of" and words[k + 1] == "the"]}
    return ner_analyzer(known, "en", "en", "[A-Za-z0-9_]+")()


@query(f"""WITH w AS (SELECT doc_id, regexp_extract_all(text, '[A-Za-z0-9_]+') AS ws FROM documents), o AS (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w)
SELECT doc_id, CASE WHEN ws[i] = 'of' THEN 'LOCATION' ELSE 'PERSON' END AS entity_type, count(*) AS n FROM o WHERE ws[i] IN ({', '.join(map(sql.text_literal, WORDS))}) OR (ws[i] = 'of' AND ws[i + 1] = 'the') GROUP BY ALL""")
def named_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Name finders, one for each type, from word ranges to spans of the text."""
    from .sources.detect import FunctionDetector

    found = FunctionDetector(_names, "NER").detect(documents(spark, sf_dir), "text", "found")
    return found.select("doc_id", F.explode("found.evidence").alias("e")).groupBy("doc_id", F.col("e.entity_type").alias("entity_type")).agg(F.count("*").alias("n"))


@query("SELECT doc_id, (length(text) + len(regexp_extract_all(text, '[\\x{10000}-\\x{10FFFF}]')))::INTEGER AS n FROM documents")
def utf16_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D12."""
    from .functions.text import utf16_length

    return documents(spark, sf_dir).select("doc_id", utf16_length(F.col("text")).alias("n"))


# --- values in trees -------------------------------------------------------------------------------------------

_TREE = """'{"a":{"t":"' || regexp_replace(coalesce(text, ''), '[^A-Za-z0-9 .,]', '' GLOBAL) || '","n":[6, 64, 1.50e1, true, null]},"Theresa ' || turn || '":[' || turn || ']}'"""
_RED_NAMES = """regexp_replace(regexp_replace({x}, 'Ther[a-z]+', '[REDACTED_PERSON]', 'g'), '[A-Z]nt[a-z]+', '[REDACTED_LOCATION]', 'g')"""


@query(rf"""WITH t AS (SELECT conv_id, turn, {_TREE.replace(" GLOBAL", ", 'g'")} AS tree FROM conversations)
SELECT conv_id, turn, replace(CASE WHEN turn BETWEEN 60 AND 69 THEN regexp_replace(red, '\[[0-9]+\]', '["[REDACTED_NATIONAL_ID]"]') ELSE red END, ' 64,', ' "[REDACTED_NATIONAL_ID]",') AS tree, true AS had FROM (SELECT *, {_RED_NAMES.format(x='tree')} AS red FROM t)""")
def json_tree_protect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names, strings and numbers of a nested value, analysed in one go."""
    rows = spread(table(spark, sf_dir, "conversations")).select("conv_id", "turn", F.expr(_TREE.replace(" GLOBAL", "")).alias("tree"))
    both = [RegexDetector(NAMES), RegexDetector(NUMBERS, "NUMBERS")]
    red, _ = jsonval.protect_json(rows, "turn", both, "REDACT", "tree", out="red")
    had, _ = jsonval.protect_json(red.drop("mode", "failure_code"), "turn", both, "CONTAINS_PII", "tree", out="had")
    return had.select("conv_id", "turn", F.col("red").alias("tree"), "had")


_LIMITED = "CASE doc_id % 4 WHEN 0 THEN repeat('[', (doc_id % 300)::INT) || '1' || repeat(']', (doc_id % 300)::INT) WHEN 1 THEN '{\"n\": 1e' || (doc_id * 13 % 9000) || '}' WHEN 2 THEN '{\"s\": \"' || repeat('x', (doc_id % 200 * 1500)::INT) || '\"}' ELSE '[' || repeat('1, ', (doc_id % 50 * 2500)::INT) || '2]' END"


@query(f"""WITH d AS (SELECT doc_id, doc_id % 4 AS kind FROM documents)
SELECT doc_id, CASE WHEN (kind = 0 AND doc_id % 300 > 128) OR (kind = 1 AND doc_id * 13 % 9000 + 3 > 4096) OR (kind = 2 AND doc_id % 200 * 1500 > 250000) OR (kind = 3 AND doc_id % 50 * 2500 + 1 > 100000) THEN 'PAYLOAD_LIMIT_EXCEEDED' END AS failure_code FROM d""")
def json_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth, expanded numbers, strings and nodes beyond their limits."""
    rows = documents(spark, sf_dir).select("doc_id", F.expr(_LIMITED.replace("::INT", "")).alias("value"))
    done, _ = jsonval.protect_json(rows, "doc_id", [RegexDetector(NAMES)], "REDACT", "value", out="protected")
    return done.select("doc_id", "failure_code")


@query("""WITH f AS (SELECT conv_id, substr(text, 1, 6) AS original, min(turn) AS first FROM conversations WHERE length(text) >= 6 GROUP BY ALL),
v AS (SELECT *, '[[PII_PERSON_' || md5(conv_id::VARCHAR) || '_' || row_number() OVER (PARTITION BY conv_id ORDER BY first) || ']]' AS token FROM f)
SELECT c.conv_id, turn, CASE WHEN length(text) >= 6 THEN token || substr(text, 7) ELSE text END AS tokenized FROM conversations c LEFT JOIN v ON v.conv_id = c.conv_id AND original = substr(text, 1, 6)""")
def scalar_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scalars with spans that are known already."""
    spans = F.when(F.length("text") >= 6, F.array(F.struct(F.lit(0).alias("start"), F.lit(6).alias("end"), F.lit("PERSON").alias("entity_type")))).otherwise(F.array().cast(rewrite.PLAIN))
    rows = spread(table(spark, sf_dir, "conversations")).withColumn("spans", spans)
    found = rewrite.found_spans(rows, "conv_id", "turn", ["turn"])
    made = rewrite.build_vault(rewrite.found_values(found), nonce=F.md5)
    return rewrite.tokenize_found(rows, found, made, "turn", "conv_id").select("conv_id", "turn", "tokenized")


# --- tools and messages ----------------------------------------------------------------------------------------


@query(f"""WITH {_NUMBERS} SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'TOOL_EXECUTION_FAILED' END AS failure_code, CASE WHEN event_id % 11 <> 0 THEN CASE WHEN hit THEN '{{"k": "' || token || '"}}' ELSE props END END AS protected
FROM n LEFT JOIN (SELECT * REPLACE ('[[PII_NATIONAL_ID_' || md5(user_id::VARCHAR) || '_' || row_number() OVER (PARTITION BY user_id ORDER BY first) || ']]' AS token) FROM (SELECT user_id, value, min(event_id) AS first, '' AS token FROM n WHERE hit AND event_id % 11 <> 0 GROUP BY ALL)) USING (user_id, value)""")
def tool_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tool gets the numbers that it may see, gives them back, and the answer is protected again."""
    rows = spread(table(spark, sf_dir, "events").select("event_id", "user_id", "props"))
    done, made = jsonval.protect_json(rows, "event_id", [RegexDetector(NUMBERS)], "TOKENIZE", "props", "user_id", ["event_id"], out="arguments", nonce=F.md5)
    echo = lambda calls: calls.withColumn("result", F.when(F.col("event_id") % 11 != 0, F.col("input")))
    back, _ = policy.call_tool(done.select("event_id", "user_id", "arguments"), made, echo, ["NATIONAL_ID"], [RegexDetector(NUMBERS)], "user_id", "event_id", nonce=F.md5)
    return back.select("event_id", "failure_code", "protected")


@query(f"""{WITH_TOKENS}, given AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN text ELSE out END AS text FROM tok JOIN documents USING (doc_id)), gev AS ({sql.evidence(SAFE, table='given')}), {sql.resolved('gev', name='resolved2')}, {sql.rewritten('red', "'[REDACTED_' || entity_type || ']'", 'resolved2', 'given')}
SELECT doc_id, out AS output, false AS blocked FROM red""")
def return_direct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokens of answers that go straight to the user become originals before the policy is applied."""
    rows, made = _tokenized(spark, sf_dir)
    given = rows.select("doc_id", "source", F.col("tokenized").alias("text"), (F.col("doc_id") % 2 == 0).alias("direct"))
    return policy.protect_return_direct(given, made, "source", "doc_id", "direct", [RULES], OutputPolicy(True, "REDACT")).select("doc_id", "output", "blocked")


@query(f"""SELECT conv_id, turn, {_RED_NAMES.format(x='text')} AS reasoning, text AS other FROM conversations""")
def reasoning_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the metadata that holds a provider's reasoning is rewritten."""
    rows = table(spark, sf_dir, "conversations").withColumn("metadata", F.create_map(F.lit("thinking"), F.col("text"), F.lit("other"), F.col("text")))
    change = lambda v: F.regexp_replace(F.regexp_replace(v, "Ther[a-z]+", "[REDACTED_PERSON]"), "[A-Z]nt[a-z]+", "[REDACTED_LOCATION]")
    done = rows.withColumn("metadata", policy.transform_reasoning(F.col("metadata"), change))
    return done.select("conv_id", "turn", F.col("metadata")["thinking"].alias("reasoning"), F.col("metadata")["other"].alias("other"))


@query("SELECT doc_id, text, lang, source FROM documents")
def stripped_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of an analysed row, an application sees what it gave."""
    return policy.strip_internal(analyzed(spark, sf_dir))


@query("""SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 'TRANSFORMATION_CONFLICT' END AS failure_code, turn % 3 <> 0 AS given FROM conversations""")
def unknown_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P20."""
    rows = table(spark, sf_dir, "conversations").withColumn("role", F.when(F.col("turn") % 6 == 0, "narrator").when(F.col("turn") % 3 != 0, F.col("role")))
    done, _ = policy.transform_messages(rows, "turn", "conv_id", ["turn"], [RegexDetector(NAMES)])
    return done.select("conv_id", "turn", "failure_code", F.col("protected").isNotNull().alias("given"))


_TOOLS = "p_partkey AS tool_name, CASE WHEN p_partkey % 13 <> 0 THEN p_name END AS description, CASE WHEN p_partkey % 7 <> 0 THEN p_type END AS schema"


def _tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(*_TOOLS.split(", "))


@query(f"""WITH t AS (SELECT {_TOOLS} FROM part) SELECT tool_name, concat_ws(',', CASE WHEN description IS NULL THEN 'description' END, CASE WHEN schema IS NULL THEN 'schema' END) AS missing FROM t WHERE description IS NULL OR schema IS NULL""")
def tools_incomplete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P16."""
    return policy.incomplete_tools(_tools(spark, sf_dir)).select("tool_name", F.array_join("missing", ",").alias("missing"))


@query(f"""WITH t AS (SELECT {_TOOLS} FROM part), b AS (SELECT * FROM t WHERE tool_name % 17 <> 0), a AS (SELECT tool_name, CASE WHEN tool_name % 11 = 0 THEN description || '!' ELSE description END AS description, schema FROM t WHERE tool_name % 19 <> 0)
SELECT tool_name, CASE WHEN tool_name % 17 = 0 THEN 'ADDED' WHEN tool_name % 19 = 0 THEN 'REMOVED' ELSE 'CHANGED' END AS change FROM t WHERE (tool_name % 17 = 0) <> (tool_name % 19 = 0) OR (tool_name % 17 <> 0 AND tool_name % 11 = 0 AND description IS NOT NULL AND tool_name % 19 <> 0)""")
def tools_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definitions that differ between two boundaries."""
    tools = _tools(spark, sf_dir)
    later = tools.where("tool_name % 19 <> 0").withColumn("description", F.when(F.col("tool_name") % 11 == 0, F.concat("description", F.lit("!"))).otherwise(F.col("description")))
    return policy.changed_tools(tools.where("tool_name % 17 <> 0"), later)


@query("""SELECT s_name AS tool_name, CASE WHEN s_nationkey % 4 <> 0 THEN 'svc' || s_nationkey % 4 END AS service_id, CASE WHEN s_nationkey % 4 = 0 THEN 'UNWRAPPED' ELSE 'OTHER_SERVICE' END AS reason FROM supplier WHERE s_nationkey % 4 <> 1""")
def tools_foreign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P10: tools without the wrapper of this service."""
    owner = F.when(F.col("s_nationkey") % 4 != 0, F.concat(F.lit("svc"), (F.col("s_nationkey") % 4).cast("string")))
    return policy.foreign_tools(table(spark, sf_dir, "supplier").select(F.col("s_name").alias("tool_name"), owner.alias("service_id")), "svc1")


@query("""WITH c AS (SELECT conv_id, turn AS id, 'message' AS source FROM conversations UNION ALL SELECT conv_id, turn, 'metadata' FROM conversations WHERE turn % 2 = 1)
SELECT conv_id, count(*) AS n, (SELECT count(*) FROM conversations x WHERE x.conv_id = c.conv_id AND turn % 2 = 1) AS doubled FROM c GROUP BY conv_id""")
def tool_calls_of_both_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls in messages and in metadata, and those that stand in both."""
    call = F.struct(F.col("turn").cast("string").alias("id"))
    none = F.array().cast("array<struct<id:string>>")
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.array(call).alias("tool_calls"), F.when(F.col("turn") % 2 == 1, F.array(call)).otherwise(none).alias("metadata_tool_calls"))
    calls = policy.all_tool_calls(rows, "conv_id").select(F.col("conv_id").alias("response_id"), F.col("call.id").alias("id"), "source")
    doubled = fr.doubled_calls(calls).groupBy("response_id").agg(F.count("*").alias("doubled"))
    return calls.groupBy("response_id").agg(F.count("*").alias("n")).join(doubled, "response_id", "left").select(F.col("response_id").alias("conv_id"), "n", F.coalesce("doubled", F.lit(0)).alias("doubled"))


# --- more streams ----------------------------------------------------------------------------------------------


@query("""WITH p AS (SELECT doc_id, text, (length(text) / 2)::BIGINT AS half FROM documents), c AS (SELECT doc_id, unnest([0, 1]) AS choice, half, text FROM p)
SELECT doc_id::VARCHAR AS response_id, choice::BIGINT AS choice, channel, CASE WHEN doc_id % 7 <> 3 THEN CASE WHEN channel = 'THOUGHT' THEN 'thinks ' || choice ELSE CASE WHEN choice = 0 THEN substr(text, 1, 100) ELSE translate(substr(text, 1, 100), 'aeiou', 'AEIOU') END END END AS text,
CASE WHEN doc_id % 7 = 3 THEN 'TRANSFORMATION_CONFLICT' END AS failure_code FROM c, (VALUES ('DEFAULT'), ('THOUGHT')) AS k(channel) WHERE length(text) > 0""")
def stream_by_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two choices told by index, in whatever position, and two channels; an index twice in a frame fails."""
    docs = documents(spark, sf_dir).where("length(text) > 0").select("doc_id", F.col("doc_id").cast("string").alias("response_id"), "text")
    parts = docs.withColumn("frame_seq", F.explode(F.sequence(F.lit(0), F.lit(4)).cast("array<bigint>"))).withColumn("choice_index", F.explode(F.array(F.lit(0), F.lit(1)).cast("array<bigint>")))
    piece = F.substring(F.substring("text", 1, 100), F.col("frame_seq") * 20 + 1, F.lit(20))
    said = parts.select("doc_id", "response_id", "frame_seq", "choice_index", F.lit("DEFAULT").alias("channel"), F.when(F.col("choice_index") == 0, piece).otherwise(F.translate(piece, "aeiou", "AEIOU")).alias("text"))
    thought = parts.where("frame_seq = 2").select("doc_id", "response_id", "frame_seq", "choice_index", F.lit("THOUGHT").alias("channel"), F.concat(F.lit("thinks "), F.col("choice_index").cast("string")).alias("text"))
    every = said.unionByName(thought).withColumn("position", ((F.col("choice_index") + F.col("frame_seq")) % 2).cast("int"))
    again = said.where("doc_id % 7 = 3 and frame_seq = 1 and choice_index = 0").withColumn("position", F.lit(5))
    return fr.join_text(fr.correlate(every.unionByName(again).drop("doc_id"))).select("response_id", "choice", "channel", "text", "failure_code")


@query("""WITH f AS (SELECT conv_id, min_by(text, turn) AS t, max(turn) AS most, count(DISTINCT turn % 2) AS names FROM conversations GROUP BY conv_id)
SELECT conv_id, CASE WHEN conv_id % 3 <> 0 THEN 'c' || conv_id END AS id, CASE WHEN conv_id % 5 = 0 AND names > 1 THEN 'TRANSFORMATION_CONFLICT' END AS failure_code, CASE WHEN NOT (conv_id % 5 = 0 AND names > 1) THEN substr(t, 1, (5 * (most + 1))::BIGINT) END AS arguments FROM f""")
def stream_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls whose arguments arrive in growing pieces, by id or by position; a name that changes fails."""
    rows = table(spark, sf_dir, "conversations")
    first = rows.groupBy("conv_id").agg(F.min_by("text", "turn").alias("t"))
    name = F.when(F.col("conv_id") % 5 == 0, F.concat(F.lit("tool"), (F.col("turn") % 2).cast("string"))).otherwise("tool")
    calls = rows.join(first, "conv_id").select(F.col("conv_id").alias("response_id"), F.col("turn").alias("frame_seq"), F.lit(0).alias("position"), F.when(F.col("conv_id") % 3 != 0, F.concat(F.lit("c"), F.col("conv_id").cast("string"))).alias("id"), name.alias("name"), F.substring("t", F.lit(1), (5 * (F.col("turn") + 1)).cast("int")).alias("arguments"))
    return fr.merge_tool_calls(calls).select(F.col("response_id").alias("conv_id"), "id", "failure_code", "arguments")


@query("""WITH f AS (SELECT conv_id, string_agg(substr(text, 1, 4), '' ORDER BY turn) AS deltas, count(*) FILTER (turn % 2 = 1) AS odd, count(*) AS n FROM (SELECT DISTINCT ON (conv_id, turn) * FROM conversations) GROUP BY conv_id)
SELECT conv_id, CASE WHEN conv_id % 4 = 0 AND odd > 0 AND odd < n THEN 'TRANSFORMATION_CONFLICT' END AS failure_code, n AS frames FROM f""")
def stream_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reasoning metadata of all frames; strings mixed with other values fail."""
    rows = table(spark, sf_dir, "conversations").dropDuplicates(["conv_id", "turn"])
    parts = rows.select(F.col("conv_id").alias("response_id"), F.col("turn").alias("frame_seq"), F.lit("thinking").alias("name"), F.concat(F.col("turn").cast("string"), F.lit(";")).alias("value"), ((F.col("conv_id") % 4 != 0) | (F.col("turn") % 2 == 1)).alias("is_string"))
    merged = fr.merge_metadata(parts, policy.REASONING_KEYS)
    return merged.join(rows.groupBy(F.col("conv_id").alias("response_id")).agg(F.count("*").alias("frames")), "response_id").select(F.col("response_id").alias("conv_id"), "failure_code", "frames")


@query("SELECT event_id, CASE WHEN event_type NOT IN ('click', 'view') THEN 'TOOL_POLICY_FAILED' END AS failure_code FROM events")
def stream_valid_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames that aren't held back."""
    return fr.pass_valid_calls(table(spark, sf_dir, "events"), ["click", "view"], "event_type").select("event_id", "failure_code")


# --- sessions and probes ---------------------------------------------------------------------------------------


@query("""SELECT event_id, CASE WHEN user_id % 5 = 0 THEN 'CONTEXT_REQUIRED' WHEN user_id % 3 <> 0 THEN 'CONTEXT_NOT_ACTIVE' END AS code, (SELECT count(DISTINCT user_id) FROM events WHERE user_id % 3 = 0) AS active FROM events""")
def session_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without a session, or of one that is closed."""
    events = table(spark, sf_dir, "events")
    active = events.where("user_id % 3 = 0").select(F.col("user_id").alias("session_id")).distinct()
    rows = events.withColumn("session", F.when(F.col("user_id") % 5 != 0, F.col("user_id")))
    return rewrite.require_active(rows, active, "session").select("event_id", F.col("failure.code").alias("code"), F.lit(evaluate.active_sessions(active)).cast("long").alias("active"))


@query(f"""{WITH_VAULT} SELECT session_id, count(*) AS n FROM vault WHERE session_id NOT IN ('src1', 'src2') GROUP BY session_id""")
def closed_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A closed session's mappings are gone."""
    made = _tokenized(spark, sf_dir)[1]
    left = rewrite.close_sessions(made, values(spark, [("src1",), ("src2",)], "session_id string"))
    return left.groupBy("session_id").agg(F.count("*").alias("n"))


@query("SELECT 'N' || n_nationkey AS id, CASE WHEN n_nationkey % 4 = 0 THEN 0 ELSE 2 END AS n_types, n_name AS text FROM nation")
def corpus_reader(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V2: a tab-separated corpus with comments and empty lists, written from a table and read back."""
    from .functions.storage import work_path
    from .sources.detect import read_corpus

    kinds = F.when(F.col("n_nationkey") % 4 == 0, "-").otherwise("PERSON,LOCATION")
    line = F.concat_ws("\t", F.concat(F.lit("N"), F.col("n_nationkey").cast("string")), kinds, kinds, "n_name")
    path = work_path(spark, "corpus")
    nation = table(spark, sf_dir, "nation")
    nation.select(line.alias("value")).unionByName(nation.select(F.concat(F.lit("# "), "n_name").alias("value"))).write.text(path)
    return read_corpus(spark, path).select("id", F.size("expected_types").alias("n_types"), "text")


@query("SELECT user_id AS session_id, event_type AS tool_name, props AS input FROM events WHERE contains(props, '6')")
def probe_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V5, V7: what tools were given, as far as it holds a value."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), F.col("event_type").alias("tool_name"), F.col("props").alias("input"), "value")
    return evaluate.holding(evaluate.snapshot(rows), "input", "6")


#: Where ``entry`` finds its tables, unless SF_DIR names another folder.
ENTRY_DIR = "/root/testdata/sf0.001"


def entry(spark: SparkSession) -> DataFrame:
    return protected_by_language(spark, os.environ.get("SF_DIR", ENTRY_DIR))

