"""Tokens, their vault, and the rewriting of text: tokenize, redact, detokenize, subtract, contains.

Replacements are joined to rows by ``row_id``, a digest of a row's key, session and text that is never null: rows with
the same key, or none, get what belongs to their own text, and rows that are equal share one answer. A row with spans
whose replacements are missing, or told in two ways, loses its text; none keeps an original by accident.

A vault is a table (session_id, entity_type, value_kind, original, token_index, token). Tokens are numbered by first
occurrence in each session and type; the order is data (order columns, then span start), never that of partitions.
"""

from __future__ import annotations

import secrets
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.storage import fitted, materialize
from ..functions.text import cut_spans, match_spans, once, replace_spans, subtract_ranges
from ..plans.model import MAX_OUTPUT_CHARS, TYPE_GRAMMAR, entity_type
from ..sources.detect import FAILURE, Detector
from .resolve import analyze

NONCE = "[a-f0-9]{32}"
TOKEN = rf"\[\[PII_(?=[A-Z0-9_]{{1,128}}_{NONCE}_){TYPE_GRAMMAR}_{NONCE}_[1-9][0-9]*\]\]"
PLAIN = "array<struct<start:int,end:int,entity_type:string>>"
#: Longest digits of an index, for bounds that hold before a token is made.
_INDEX_CHARS = 10


def token_pattern(kind: str | None = None) -> str:
    """S3: pattern of all tokens, or of one type's."""
    return TOKEN if kind is None else rf"\[\[PII_{entity_type(kind)}_{NONCE}_[1-9][0-9]*\]\]"


def is_token(value: Column) -> Column:
    return F.coalesce(value.rlike(rf"\A{TOKEN}\z"), F.lit(False))


def make_token(kind: Column, nonce: Column, index: Column) -> Column:
    return F.concat(F.lit("[[PII_"), kind, F.lit("_"), nonce, F.lit("_"), index.cast("string"), F.lit("]]"))


def session_nonce(session: Column, secret: str) -> Column:
    """32 hexadecimal digits that nobody can tell without the secret, and the same in every retry of a task."""
    return F.substring(F.sha2(F.concat(F.lit(secret), F.lit(":"), session.cast("string")), 256), 1, 32)


def nonces(secret: str | None = None) -> Callable[[Column], Column]:
    """From session to nonce. Without a secret a random one is drawn, here and now: one for all tasks of the vault."""
    drawn = secrets.token_hex(32) if secret is None else secret
    return lambda session: session_nonce(session, drawn)


def row_id(key: str | None, session: str, text: str) -> Column:
    """Digest of a row's key, session and text; null values count as values."""
    parts = [F.coalesce(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-")) for c in ([key] if key else []) + [session]]
    return F.sha2(F.concat_ws("|", *parts, F.coalesce(F.col(text), F.lit(""))), 256)


def plain_spans(spans: Column) -> Column:
    """Start, end and type only."""
    return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["entity_type"].alias("entity_type")))


# --- redaction -------------------------------------------------------------------------------------------------


def marker(kind: Column) -> Column:
    return F.concat(F.lit("[REDACTED_"), kind, F.lit("]"))


def too_long(text: Column, spans: Column, put_length, limit: int = MAX_OUTPUT_CHARS) -> Column:
    """Whether the output could pass the limit, by lengths alone."""
    change = F.aggregate(spans, F.lit(0), lambda a, x: a + put_length(x) - (x["end"] - x["start"]))
    return F.length(text) + change > limit


def redact(df: DataFrame, text: str = "text", spans: str = "spans", out: str = "redacted", limit: int = MAX_OUTPUT_CHARS) -> DataFrame:
    """Adds ``out``; null where spans are null (the analysis failed) or the output would be too long."""
    value, found = F.col(text), plain_spans(F.col(spans))
    over = too_long(value, found, lambda x: F.length(marker(x["entity_type"])), limit)
    put = F.transform(found, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), marker(x["entity_type"]).alias("put")))
    df = once(df, _put=F.when(F.col(spans).isNotNull() & ~over, put))
    return once(df, **{out: replace_spans(value, F.col("_put"))}).drop("_put")


def contains_pii(spans: Column) -> Column:
    """Null spans (a failed analysis) count as containing some."""
    return F.coalesce(F.size(spans) > 0, F.lit(True))


# --- numbering -------------------------------------------------------------------------------------------------


#: Rows that one range of a numbering holds at about.
RANGE_ROWS = 2_000_000


def number_densely(rows: DataFrame, keys: Sequence[str], order: Sequence[str], out: str, partitions: int | None = None) -> DataFrame:
    """Adds 1, 2, ... within ``keys`` by ``order``. A group of any size is spread over many tasks: rows are dealt by ranges
    of (keys, order), numbered within their range, and shifted by the sizes of the group's earlier ranges."""
    rows = materialize(rows, "number-rows")
    n = partitions or max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // RANGE_ROWS))
    # written once: numbers and sizes must come from the same ranges, also after a lost executor
    dealt = materialize(rows.repartitionByRange(n, *keys, *order).withColumn("_part", F.spark_partition_id()), "number")
    inside = dealt.withColumn("_k", F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*order)))
    sizes = dealt.groupBy(*keys, "_part").count()
    before = F.sum("count").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    shifts = sizes.select(*keys, "_part", F.coalesce(before, F.lit(0)).alias("_shift"))
    names = [*keys, "_part"]
    shifts = shifts.select(*(F.col(c).alias(f"_s{c}") for c in names), "_shift")
    joined = inside.join(shifts, [F.col(c).eqNullSafe(F.col(f"_s{c}")) for c in names])
    return joined.withColumn(out, (F.col("_k") + F.col("_shift")).cast("long")).drop("_part", "_k", "_shift", *(f"_s{c}" for c in names))


def build_vault(found: DataFrame, secret: str | None = None, nonce: Callable[[Column], Column] | None = None) -> DataFrame:
    """One row for each distinct value of a session and type. Repeats are combined before the shuffle.

    A session's nonce is ``nonce`` of its id, if given; else it comes from the secret, or from a random one."""
    firsts = found.groupBy("session_id", "entity_type", "value_kind", "original").agg(F.min("at").alias("first"))
    numbered = number_densely(firsts, ["session_id", "entity_type"], ["first", "value_kind", "original"], "token_index")
    token = make_token(F.col("entity_type"), (nonce or nonces(secret))(F.col("session_id")), F.col("token_index"))
    return numbered.select("session_id", "entity_type", "value_kind", "original", "token_index", token.alias("token"))


# --- tokenize and detokenize -----------------------------------------------------------------------------------


_PUT = "array<struct<start:int,end:int,put:string>>"


def _arrays(hits: DataFrame, fields: str, out: str) -> DataFrame:
    """One array of distinct hits (ordered) for each ``_rid``."""
    return hits.select("_rid", *fields.split()).distinct().groupBy("_rid").agg(F.array_sort(F.collect_list(F.struct(*fields.split()))).alias(out))


def apply_puts(df: DataFrame, hits: DataFrame, key: str, session: str, text: str, out: str) -> DataFrame:
    """Adds ``out``: ``text`` with the replacements of ``hits`` (_rid, start, end, put). Only the replacements move, as long
    as those are counted to be small enough to be broadcast; beyond, both sides are dealt by row id."""
    puts = materialize(_arrays(hits, "start end put", "_put"), "puts")
    some = F.when(F.contains(F.col(text), F.lit("[[PII_")), row_id(key, session, text))
    joined = df.withColumn("_rid", some).join(fitted(puts), "_rid", "left")
    return joined.withColumn(out, F.when(F.col("_put").isNull(), F.col(text)).otherwise(replace_spans(F.col(text), F.col("_put")))).drop("_put", "_rid")


def found_spans(df: DataFrame, session: str, key: str, order: Sequence[str], text: str = "text", spans: str = "spans", kind: str = "text", limit: int = MAX_OUTPUT_CHARS) -> DataFrame:
    """The narrow outcome of an analysis, written once: for each row with spans, or without an answer (failed, or T7:
    its tokens could make it too long), its id, session_id, order columns and spans with their originals.

    Everything after detection works on this table, so that no text is analysed twice and none is carried along."""
    longest = lambda x: F.lit(6 + 1 + 32 + 1 + _INDEX_CHARS + 2) + F.length(x["entity_type"])
    df = once(df, _plain=plain_spans(F.col(spans)))
    some = df.where(F.col(text).isNotNull() & (F.col("_plain").isNull() | (F.size("_plain") > 0)))
    refused = F.col("_plain").isNull() | F.col(session).isNull() | too_long(F.col(text), F.col("_plain"), longest, limit)
    some = once(some, _values=F.when(~refused, cut_spans(F.col(text), F.col("_plain"))))
    parts = F.zip_with("_plain", "_values", lambda x, v: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["entity_type"].alias("entity_type"), F.lit(kind).alias("value_kind"), v.alias("original")))
    narrow = some.select(row_id(key, session, text).alias("_rid"), F.col(session).cast("string").alias("session_id"), F.struct(*(F.col(c).alias(f"o{k}") for k, c in enumerate(order))).alias("_order"), F.coalesce(refused, F.lit(True)).alias("_refused"), F.when(~refused, parts).alias("_spans"))
    return materialize(narrow, "found")


def found_values(found: DataFrame) -> DataFrame:
    """A row for each span of ``found_spans``: what ``build_vault`` takes."""
    one = found.where("not _refused").select("session_id", "_order", F.explode("_spans").alias("s"))
    return one.select("session_id", F.col("s.entity_type").alias("entity_type"), F.col("s.value_kind").alias("value_kind"), F.col("s.original").alias("original"), F.struct("_order", F.col("s.start").alias("start")).alias("at"))


def tokenize_found(df: DataFrame, found: DataFrame, vault: DataFrame, key: str, session: str, text: str = "text", out: str = "tokenized") -> DataFrame:
    """Adds ``out`` to ``df``. Rows that ``found`` doesn't name keep their text; a row that it names keeps it only with
    every span replaced, else it is null."""
    # rows of one id have equal texts; where their spans aren't, none of them has an answer
    same = found.groupBy("_rid").agg(F.bool_or("_refused").alias("_refused"), F.count_distinct(F.hash("_spans"), F.xxhash64("_spans")).alias("_ways"), F.max(F.size("_spans")).alias("_wanted"))
    one = found.where("not _refused").select("_rid", "session_id", F.explode("_spans").alias("s")).select("_rid", "session_id", "s.*").distinct()
    filled = one.join(vault.select("session_id", "entity_type", "value_kind", "original", F.col("token").alias("put")), ["session_id", "entity_type", "value_kind", "original"])
    named = same.join(_arrays(filled, "start end put", "_put"), "_rid", "left")
    named = materialize(named.select("_rid", (F.col("_refused") | (F.col("_ways") != 1) | F.coalesce(F.size("_put") != F.col("_wanted"), F.lit(True))).alias("_refused"), "_put"), "puts")
    joined = df.withColumn("_rid", F.when(F.col(text).isNotNull(), row_id(key, session, text))).join(fitted(named), "_rid", "left")
    value = F.when(F.col("_refused").isNull(), F.col(text)).when(~F.col("_refused"), replace_spans(F.col(text), F.col("_put")))
    return joined.withColumn(out, value).drop("_put", "_refused", "_rid")


def tokenize(df: DataFrame, vault: DataFrame, session: str, key: str, text: str = "text", spans: str = "spans", out: str = "tokenized", kind: str = "text", limit: int = MAX_OUTPUT_CHARS) -> DataFrame:
    """Adds ``out`` to analysed rows, with the tokens of a vault that has all their values."""
    return tokenize_found(df, found_spans(df, session, key, [key], text, spans, kind, limit), vault, key, session, text, out)


def token_ranges(df: DataFrame, session: str, key: str, text: str = "text", also: Sequence[str] = ()) -> DataFrame:
    """T5 candidates: _rid, session_id, ``also``, token, start, end of each token-shaped string (owned or not)."""
    some = df.where(F.contains(F.col(text), F.lit("[[PII_")))
    found = some.select(row_id(key, session, text).alias("_rid"), F.col(session).cast("string").alias("session_id"), *also, F.explode(match_spans(F.col(text), TOKEN)).alias("m"))
    return found.select("_rid", "session_id", *also, F.col("m.value").alias("token"), F.col("m.start").alias("start"), F.col("m.end").alias("end"))


def allowed_vault(vault: DataFrame, allowed: DataFrame | Sequence[str] | None = None) -> DataFrame:
    """The part of a vault that a scope (types, or a table with entity_type) may see; None sees all."""
    if allowed is None:
        return vault
    if isinstance(allowed, DataFrame):
        return vault.join(allowed.select("entity_type").distinct(), "entity_type", "left_semi")
    return vault.where(F.col("entity_type").isin(list(allowed)) if allowed else F.lit(False))


def detokenize(df: DataFrame, vault: DataFrame, session: str, key: str, text: str = "text", out: str = "restored", allowed: DataFrame | Sequence[str] | None = None) -> DataFrame:
    """Adds ``out``: tokens of the row's own session and scope become their originals; others stay."""
    hits = token_ranges(df, session, key, text).join(allowed_vault(vault, allowed).select("session_id", "token", F.col("original").alias("put")), ["session_id", "token"])
    return apply_puts(df, hits, key, session, text, out)


def exclude_known_tokens(df: DataFrame, vault: DataFrame, session: str, key: str, text: str = "text", spans: str = "spans") -> DataFrame:
    """T4, T5: spans without the ranges of the session's own tokens; what is left of a span stays protected."""
    known = token_ranges(df, session, key, text).join(vault.select("session_id", "token"), ["session_id", "token"], "left_semi")
    arrays = materialize(_arrays(known, "start end", "_known"), "known")
    some = F.when(F.contains(F.col(text), F.lit("[[PII_")), row_id(key, session, text))
    joined = df.withColumn("_rid", some).join(fitted(arrays), "_rid", "left")
    left = subtract_ranges(plain_spans(F.col(spans)), F.coalesce("_known", F.array().cast("array<struct<start:int,end:int>>")))
    return joined.withColumn(spans, F.when(F.col(spans).isNotNull(), left)).drop("_known", "_rid")


def analyze_and_tokenize(df: DataFrame, detectors: Sequence[Detector], session: str, key: str, order: Sequence[str], text: str = "text", out: str = "tokenized", secret: str | None = None, vault: DataFrame | None = None, nonce: Callable[[Column], Column] | None = None, **settings) -> tuple[DataFrame, DataFrame]:
    """(rows with ``out``, vault) from exactly one analysis; a given vault's tokens are known and kept."""
    analyzed = analyze(df, detectors, text, **settings)
    if vault is not None:
        analyzed = exclude_known_tokens(analyzed, vault, session, key, text)
    found = found_spans(analyzed, session, key, order, text)
    values = found_values(found)
    made = materialize(build_vault(values, secret, nonce) if vault is None else extend_vault(vault, values, secret, nonce), "vault")
    return tokenize_found(df, found, made, key, session, text, out), made


def extend_vault(vault: DataFrame, found: DataFrame, secret: str | None = None, nonce: Callable[[Column], Column] | None = None) -> DataFrame:
    """Known values keep their tokens; new ones are numbered on from the session's and type's last, with the session's nonce."""
    key = ["session_id", "entity_type", "value_kind", "original"]
    fresh = build_vault(found.join(vault.select(key), key, "left_anti"), secret, nonce)
    last = vault.groupBy("session_id", "entity_type").agg(F.max("token_index").alias("_last"))
    own = vault.groupBy("session_id").agg(F.max(F.regexp_extract("token", f"_({NONCE})_[1-9][0-9]*\\]\\]$", 1)).alias("_nonce"))
    shifted = fresh.join(last, ["session_id", "entity_type"], "left").join(own, "session_id", "left").withColumn("token_index", F.col("token_index") + F.coalesce("_last", F.lit(0)))
    drawn = F.regexp_extract("token", f"_({NONCE})_[1-9][0-9]*\\]\\]$", 1)
    shifted = shifted.withColumn("token", make_token(F.col("entity_type"), F.coalesce("_nonce", drawn), F.col("token_index")))
    return vault.select(*key, "token_index", "token").unionByName(shifted.select(*key, "token_index", "token"))


# --- sessions --------------------------------------------------------------------------------------------------


def require_active(df: DataFrame, active: DataFrame, session: str) -> DataFrame:
    """Adds ``failure``: CONTEXT_REQUIRED without a session, CONTEXT_NOT_ACTIVE for one that isn't open."""
    names = active.select(F.col("session_id").alias(session)).distinct().withColumn("_open", F.lit(True))
    code = F.when(F.col(session).isNull(), "CONTEXT_REQUIRED").when(F.col("_open").isNull(), "CONTEXT_NOT_ACTIVE")
    failure = F.when(code.isNotNull(), F.struct(F.lit("").alias("provider"), code.alias("code"), F.lit("SESSION").alias("phase"), F.lit(1).alias("attempt_count")))
    return df.join(names, session, "left").withColumn("failure", failure.cast(FAILURE)).drop("_open")


def close_sessions(vault: DataFrame, closed: DataFrame) -> DataFrame:
    """The vault without the closed sessions' mappings."""
    return vault.join(closed.select("session_id"), "session_id", "left_anti")

