"""DuckDB SQL of the same operators, from which the oracles are put together."""

from __future__ import annotations

from collections.abc import Sequence

from .model import RegexRule


def text_literal(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def evidence(rules: Sequence[RegexRule], provider: str = "REGEX", table: str = "documents", key: str = "doc_id", text: str = "text") -> str:
    """Key, provider, entity_type, start, end, score, value of each match."""
    one = []
    for r in rules:
        p = text_literal(r.pattern)
        one.append(f"""
  SELECT {key}, '{provider}' AS provider, '{r.entity_type}' AS entity_type, s::INTEGER AS "start", (s + length(v))::INTEGER AS "end", {r.score}::DOUBLE AS score, v AS value FROM (
    SELECT {key}, m[i] AS v, coalesce(list_sum(list_transform(g[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS s
    FROM (SELECT {key}, regexp_split_to_array({text}, {p}) AS g, regexp_extract_all({text}, {p}) AS m FROM {table}), unnest(range(1, len(m) + 1)) AS t(i))""")
    return " UNION ALL ".join(one)


def resolved(source: str, key: str = "doc_id", name: str = "resolved") -> str:
    """R1-R6 as tables {name}_o, _c, _b, _r and ``name`` over the evidence table ``source``."""
    line = f'PARTITION BY {key} ORDER BY "start", "end", provider, entity_type, score'
    return f"""
{name}_o AS (SELECT *, max("end") OVER ({line} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm FROM {source}),
{name}_c AS (SELECT *, sum(CASE WHEN pm IS NULL OR "start" >= pm THEN 1 ELSE 0 END) OVER ({line} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cid FROM {name}_o),
{name}_b AS (SELECT *, min("start") OVER (PARTITION BY {key}, cid) AS cs, max("end") OVER (PARTITION BY {key}, cid) AS ce FROM {name}_c),
{name}_r AS (SELECT {key}, cs AS "start", ce AS "end", count(*) AS n, count(DISTINCT provider) AS np, count(DISTINCT entity_type) AS nt, min(entity_type) AS t,
  count(*) FILTER ("start" = cs AND "end" = ce) AS ne, count(DISTINCT entity_type) FILTER ("start" = cs AND "end" = ce) AS nc, min(entity_type) FILTER ("start" = cs AND "end" = ce) AS tc
  FROM {name}_b GROUP BY {key}, cid, cs, ce),
{name} AS (SELECT {key}, "start", "end", n, np, CASE WHEN nc = 1 THEN tc WHEN nt = 1 THEN t ELSE 'PII' END AS entity_type,
  CASE WHEN n = 1 THEN 'SINGLE_EVIDENCE' WHEN ne = n AND nt = 1 THEN 'EXACT_MATCH' WHEN ne = n THEN 'TYPE_CONFLICT' WHEN nc = 1 THEN 'COVERING_EVIDENCE' WHEN nt > 1 THEN 'TYPE_CONFLICT' ELSE 'OVERLAP_UNION' END AS reason
  FROM {name}_r)"""


def rewritten(name: str, put: str, source: str, table: str = "documents", key: str = "doc_id", text: str = "text") -> str:
    """Table ``name`` (key, out): ``text`` with the spans of ``source`` (key, start, end, ...) replaced by ``put``."""
    return f"""
{name}_p AS (SELECT {key}, "start", "end", {put} AS put, coalesce(lag("end") OVER (PARTITION BY {key} ORDER BY "start"), 0) AS prev FROM {source}),
{name}_a AS (SELECT {key}, string_agg(substr({text}, prev + 1, "start" - prev) || put, '' ORDER BY "start") AS head, max("end") AS last FROM {name}_p JOIN {table} USING ({key}) GROUP BY {key}),
{name} AS (SELECT {key}, CASE WHEN head IS NULL THEN {text} ELSE head || substr({text}, last + 1) END AS out FROM {table} LEFT JOIN {name}_a USING ({key}))"""


def vault(source: str, order: str) -> str:
    """Table ``vault`` over ``source`` (session_id, entity_type, value_kind, original, and the order columns)."""
    return f"""
_f AS (SELECT session_id, entity_type, value_kind, original, min(({order})) AS first FROM {source} GROUP BY ALL),
vault AS (SELECT session_id, entity_type, value_kind, original, token_index, '[[PII_' || entity_type || '_' || md5(session_id) || '_' || token_index || ']]' AS token
  FROM (SELECT *, row_number() OVER (PARTITION BY session_id, entity_type ORDER BY first, value_kind, original) AS token_index FROM _f))"""
