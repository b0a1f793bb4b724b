"""Structured values: the scalars of a JSON text are analysed like texts, and only what changes is written anew.

Arrow-batched functions do what no built-in can, as untouched number lexemes must survive byte for byte: one checks a
payload and lists its scalars, one deals spans to scalars, one puts replacements in place. Whole rows go through them
(``_through``): beside a function in a projection, rows wait in a queue that grows to gigabytes where payloads are long. Detection and resolution in
between are the same operators as for plain text, on the distinct scalars of a payload joined to one text by SEPARATOR.
So a payload is analysed once, in its row: redaction and the search for personal data shuffle nothing and need no key.
Tokens are numbered from a narrow table and come back by ``row_id``, as for text; what has no answer is null.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from decimal import Decimal, InvalidOperation

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.storage import fitted, materialize
from ..functions.text import match_spans, once
from ..plans.model import FALLBACK_TYPE, MAX_DEPTH, MAX_EXPANDED_NUMBER_CHARS, MAX_INPUT_CHARS, MAX_NODES, MAX_NUMBER_CHARS, MAX_OUTPUT_CHARS, MAX_STRING_CHARS
from ..sources.detect import Detector, depth_of
from .resolve import analyze
from .rewrite import TOKEN, allowed_vault, build_vault, marker, plain_spans, row_id

_SCALAR = re.compile(r'"[^"\\]*(?:\\.[^"\\]*)*"|-?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?')
#: What stands between two scalars in the text that is analysed; a span that crosses it is a conflict.
SEPARATOR = "\n\0\n"
_STRING = re.compile(r'("[^"\\]*(?:\\.[^"\\]*)*")')
_MARKS = str.maketrans("[]{},:", "      ")
_NO_SCALARS = ("true", "false", "null")
_IS_NAME = re.compile(r"[ \t\r\n]*:")


class Refused(Exception):
    """A payload that can't be handled; the code says why."""


def _distinct_names(pairs: list) -> dict:
    out = dict(pairs)
    if len(out) < len(pairs):
        raise Refused("TRANSFORMATION_CONFLICT")
    return out


def _no_constant(name: str):
    raise ValueError(name)


def plain_number(lexeme: str) -> str:
    """A number's digits without exponent, its length bounded before any digit is made."""
    if re.fullmatch("-?[0-9]+", lexeme):
        return lexeme
    try:
        value = Decimal(lexeme)
    except InvalidOperation:
        raise Refused("PAYLOAD_LIMIT_EXCEEDED") from None
    _, digits, exponent = value.as_tuple()
    if not isinstance(exponent, int) or len(digits) + abs(exponent) + 2 > MAX_EXPANDED_NUMBER_CHARS:
        raise Refused("PAYLOAD_LIMIT_EXCEEDED")
    return format(value, "f")


def _repeats(text: str) -> bool | None:
    """Whether an object of the JSON value ``text`` has a name twice; None if it is no JSON value."""
    if len(text) > MAX_INPUT_CHARS:
        raise Refused("PAYLOAD_LIMIT_EXCEEDED")
    # brackets in strings count here, so only a text that may be too deep is looked at closely
    if text.count("[") + text.count("{") > MAX_DEPTH and depth_of(text.encode("utf-8", "surrogatepass")) > MAX_DEPTH:
        raise Refused("PAYLOAD_LIMIT_EXCEEDED")
    repeats = False

    def names(pairs: list) -> dict:
        nonlocal repeats
        out = dict(pairs)
        repeats |= len(out) < len(pairs)
        return out

    try:
        json.loads(text, parse_constant=_no_constant, parse_int=str, parse_float=str, object_pairs_hook=names)
    except (ValueError, RecursionError):
        return None
    return repeats


def _value(lexeme: str) -> str:
    """The analysis text of a string or number as it is written."""
    if lexeme[0] != '"':
        if len(lexeme) > MAX_NUMBER_CHARS:
            raise Refused("PAYLOAD_LIMIT_EXCEEDED")
        return plain_number(lexeme)
    value = json.loads(lexeme) if "\\" in lexeme else lexeme[1:-1]
    if len(value) > MAX_STRING_CHARS:
        raise Refused("PAYLOAD_LIMIT_EXCEEDED")
    return value


def scalars(text: str) -> list[tuple[int, int, str, str]] | None:
    """(start, end, kind, analysis text) of each name, string and number; None if ``text`` is no JSON value."""
    if _repeats(text) is None:
        return None
    out, values = [], {}
    for m in _SCALAR.finditer(text):
        if len(out) >= MAX_NODES:
            raise Refused("PAYLOAD_LIMIT_EXCEEDED")
        lexeme = m[0]
        if lexeme not in values:
            values[lexeme] = _value(lexeme)
        kind = "number" if lexeme[0] != '"' else "name" if _IS_NAME.match(text, m.end()) else "string"
        out.append((m.start(), m.end(), kind, values[lexeme]))
    return out


def rewrite(text: str, put: dict[tuple[str, str], tuple[str, str]]) -> str:
    """``put`` maps (kind, analysis text) to (written kind, text); all else stays as it was written."""
    pieces, at = [], 0
    for start, end, kind, value in scalars(text) or []:
        new = put.get(("string" if kind == "name" else kind, value))
        if new is None or (new[1] == value and new[0] == kind):
            continue
        if kind == "name" and new[0] == "number":
            new = ("string", new[1])
        pieces += [text[at:start], new[1] if new[0] == "number" else json.dumps(new[1], ensure_ascii=_sound(new[1]) != new[1])]
        at = end
    out = "".join([*pieces, text[at:]])
    if len(out) > MAX_OUTPUT_CHARS:
        raise Refused("PAYLOAD_LIMIT_EXCEEDED")
    json.loads(out, object_pairs_hook=_distinct_names)
    return out


def distinct_scalars(text: str) -> tuple[list[tuple[str, str]] | None, bool]:
    """(kind, analysis text) of the distinct scalars, names counted as strings, in order; None if ``text`` is no JSON
    value. And whether an object has a name twice. A lexeme is looked at once, however often it is written."""
    repeats = _repeats(text)
    if repeats is None:
        return None, False
    nodes, written = 0, {}
    for piece, n in Counter(_STRING.split(text)).items():  # strings, and what stands between them
        words = [piece] if piece[:1] == '"' else piece.translate(_MARKS).split()
        each = dict.fromkeys(words)
        nodes += n * (len(words) - sum(words.count(x) for x in _NO_SCALARS if x in each))
        written |= each
    if nodes > MAX_NODES:
        raise Refused("PAYLOAD_LIMIT_EXCEEDED")
    return list(dict.fromkeys(("string" if x[0] == '"' else "number", _value(x)) for x in written if x not in _NO_SCALARS)), repeats


def _read(text: str | None) -> tuple[str | None, str | None, list[tuple[str, str]], bool]:
    """Mode (json, text or refused), failure code, scalars (those of the JSON value, or the text as the only one), and
    whether an object has a name twice."""
    if text is None:
        return None, None, [], False
    try:
        found, repeats = distinct_scalars(text)
    except Refused as e:
        return "refused", str(e), [], False
    return ("text", None, [("string", text)], False) if found is None else ("json", None, found, repeats)


#: Bytes of rows that a function hands on at once.
_SLICE_BYTES = 4 << 20


def _through(df: DataFrame, given: Sequence[str], make: Callable[..., tuple], new: dict[str, tuple[str, pa.DataType]], some: str | None = None) -> DataFrame:
    """``df`` and the columns ``new`` (by name: type in SQL, in Arrow) that ``make`` gives for the columns ``given`` of a row;
    null in rows where ``some`` is null, if named, which aren't read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, batch.num_rows * _SLICE_BYTES // max(batch.nbytes, 1))
            for at in range(0, batch.num_rows, step):
                rows = batch.slice(at, step)
                asked = rows.column(some).is_valid().to_pylist() if some else [True] * rows.num_rows
                values = [rows.column(c) for c in given]
                made = [make(*(v[k].as_py() for v in values)) if ask else (None,) * len(new) for k, ask in enumerate(asked)]
                columns = [pa.array([m[k] for m in made], kind) for k, (_, kind) in enumerate(new.values())]
                yield pa.RecordBatch.from_arrays([*rows.columns, *columns], names=[*rows.schema.names, *new])

    return df.mapInArrow(run, StructType([*df.schema.fields, *StructType.fromDDL(", ".join(f"`{c}` {t}" for c, (t, _) in new.items())).fields]))


def _sound(text: str) -> str:
    """``text`` with half surrogates, which JSON can escape but no column can hold, as question marks."""
    return text if text.isascii() else text.encode("utf-8", "replace").decode()


_SCALARS = ("array<struct<kind:string,value:string>>", pa.list_(pa.struct([("kind", pa.string()), ("value", pa.string())])))


def list_scalars(df: DataFrame, text: str) -> DataFrame:
    """Adds mode, code and distinct scalars of a payload, and whether an object has a name twice."""

    def make(t):
        mode, code, found, repeats = _read(t)
        return mode, code, [{"kind": k, "value": _sound(v)} for k, v in found], repeats

    return _through(df, [text], make, {"_mode": ("string", pa.string()), "_unread": ("string", pa.string()), "_scalars": _SCALARS, "_repeats": ("boolean", pa.bool_())})


def deal(found: list[tuple[str, str]], spans: list[dict], fallback: str = FALLBACK_TYPE) -> list[dict] | None:
    """Spans of the joined text as spans of its scalars; None if one crosses a separator. Any span protects a
    whole number; several types become the fallback type."""
    out, at, k = [], 0, 0
    numbers: dict[int, set[str]] = {}
    for x in spans:
        while k < len(found) and x["start"] >= at + len(found[k][1]) + len(SEPARATOR):
            at += len(found[k][1]) + len(SEPARATOR)
            k += 1
        start, end = x["start"] - at, x["end"] - at
        if k == len(found) or end > len(found[k][1]):
            return None
        if found[k][0] == "number":
            numbers.setdefault(k, set()).add(x["entity_type"])
        else:
            out.append({"scalar": k, "start": start, "end": end, "entity_type": x["entity_type"], "value_kind": "text", "original": found[k][1][start:end]})
    for k, kinds in numbers.items():
        out.append({"scalar": k, "start": 0, "end": len(found[k][1]), "entity_type": kinds.pop() if len(kinds) == 1 else fallback, "value_kind": "number", "original": found[k][1]})
    return sorted(out, key=lambda x: (x["scalar"], x["start"]))


_PLACED = "array<struct<scalar:int,start:int,end:int,entity_type:string,value_kind:string,original:string>>"
_PLACED_ARROW = pa.list_(pa.struct([("scalar", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("entity_type", pa.string()), ("value_kind", pa.string()), ("original", pa.string())]))


def _deal(scalars: list[dict], spans: list[dict]) -> tuple[list[dict] | None, str | None]:
    placed = deal([(x["kind"], x["value"]) for x in scalars], spans)
    return placed, "TRANSFORMATION_CONFLICT" if placed is None else None


def _redact(text: str | None, spans: list[dict]) -> tuple[str | None, str | None]:
    """Payload and failure code of a row with spans."""
    placed = deal(_read(text)[2], spans)
    if placed is None:
        return None, "TRANSFORMATION_CONFLICT"
    payload, _, code = _put_scalars(text, [{"scalar": x["scalar"], "start": x["start"], "end": x["end"], "put": marker_of(x["entity_type"]), "number": False} for x in placed])
    return payload, code


def marker_of(entity_type: str) -> str:
    """What ``rewrite.marker`` gives."""
    return f"[REDACTED_{entity_type}]"


def _put_scalars(t: str | None, put: list | None) -> tuple[str | None, str | None, str | None]:
    mode, code, found, repeats = _read(t)
    if code or t is None:
        return None, mode, code
    if not put:
        code = "PAYLOAD_LIMIT_EXCEEDED" if len(t) > MAX_OUTPUT_CHARS else "TRANSFORMATION_CONFLICT" if repeats else None
        return None if code else t, mode, code
    by: dict[int, list] = {}
    for p in put:
        by.setdefault(p["scalar"], []).append(p)
    new = {}
    for k, parts in by.items():
        value, pieces, at = found[k][1], [], 0
        for p in sorted(parts, key=lambda p: p["start"]):
            pieces += [value[at : p["start"]], p["put"]]
            at = p["end"]
        whole = len(parts) == 1 and parts[0]["number"] and (parts[0]["start"], parts[0]["end"]) == (0, len(value))
        new[found[k]] = "number" if whole else "string", "".join([*pieces, value[at:]])
    try:
        if mode == "text":
            out = new.get(found[0], ("string", t))[1]
            return (None, mode, "PAYLOAD_LIMIT_EXCEEDED") if len(out) > MAX_OUTPUT_CHARS else (out, mode, None)
        return rewrite(t, new), mode, None
    except Refused as e:
        return None, mode, str(e)


def analyze_scalars(df: DataFrame, text: str, detectors: Sequence[Detector], also: Sequence[Column] = (), **settings) -> DataFrame:
    """A row of ``df`` as struct ``_row``, ``also``, and of its payload: ``_text``, ``_mode``, ``_scalars``, ``_repeats`` (an
    object has a name twice), ``_spans`` (of the joined scalars; null: none) and ``_code`` (why there are none)."""
    rest = [c for c in df.columns if c != text]  # the payload goes through the functions once
    held = df.select(F.struct(F.lit(True).alias("_is"), *(F.col(f"`{c}`") for c in rest)).alias("_row"), F.col(text).alias("_text"), *also)
    held = list_scalars(held, "_text")
    held = once(held, _joined=F.array_join(F.transform("_scalars", lambda x: x["value"]), SEPARATOR))
    done = analyze(held, detectors, "_joined", **settings)
    code = F.when(F.col("_text").isNotNull(), F.coalesce("_unread", "failure.code"))
    spans = F.when((F.size("spans") > 0) & code.isNull(), plain_spans(F.col("spans")))
    return once(done, _code=code, _spans=spans).drop("_joined", "_unread", "spans", "succeeded", "failures", "failure")


def _given(df: DataFrame, text: str) -> list[Column]:
    """The columns of ``df`` from ``_row`` and ``_text``."""
    return [(F.col("_text") if c == text else F.col(f"_row.`{c}`")).alias(c) for c in df.columns]


def protect_json(df: DataFrame, key: str, detectors: Sequence[Detector], action: str = "REDACT", text: str = "text", session: str | None = None, order: Sequence[str] = (), strict: bool = False, out: str = "payload", secret: str | None = None, nonce: Callable[[Column], Column] | None = None, **settings) -> tuple[DataFrame, DataFrame | None]:
    """Adds ``out``, ``mode`` and ``failure_code``; gives the vault too when tokens are made.

    ``strict``: a payload that isn't JSON is TRANSFORMATION_CONFLICT, not plain text. Null payload where a failure is set.
    A null session can't have tokens: CONTEXT_REQUIRED. Null and repeated keys are like any other.
    """
    own = [] if action != "TOKENIZE" else [F.col(session).cast("string").alias("_session"), row_id(key, session, text).alias("_rid"), F.struct(*(F.col(c).alias(f"o{k}") for k, c in enumerate(order))).alias("_order")]
    done = analyze_scalars(df, text, detectors, own, **settings)
    if action == "REDACT":
        done = _through(done.drop("_scalars"), ["_text", "_spans"], _redact, {"_payload": ("string", pa.string()), "_lost": ("string", pa.string())}, "_spans")
        same = F.when(F.length("_text") > MAX_OUTPUT_CHARS, "PAYLOAD_LIMIT_EXCEEDED").when(F.col("_repeats"), "TRANSFORMATION_CONFLICT")
        new = F.struct(F.coalesce("_payload", "_text").alias("payload"), F.coalesce("_lost", F.when(F.col("_spans").isNull(), same)).alias("code"))
        return _written(done.withColumn("_new", new), _given(df, text), "_mode", F.col("_code"), strict, out), None
    done = _through(done, ["_scalars", "_spans"], _deal, {"_placed": (_PLACED, _PLACED_ARROW), "_crossed": ("string", pa.string())}, "_spans")
    code = F.coalesce("_code", "_crossed")
    done = once(done, _code=code, _placed=F.when(code.isNull(), F.coalesce("_placed", F.array().cast(_PLACED))))
    if action == "CONTAINS_PII":
        hit = F.when(F.col("_text").isNull(), False).when(F.col("_code").isNotNull(), True).otherwise(F.size("_placed") > 0)
        return done.select(*_given(df, text), hit.alias(out), F.col("_mode").alias("mode"), F.col("_code").alias("failure_code")), None
    some = done.where(F.col("_text").isNotNull() & (F.col("_code").isNotNull() | (F.size("_placed") > 0)))
    code = F.coalesce("_code", F.when(F.col("_session").isNull(), "CONTEXT_REQUIRED"))
    found = materialize(some.select("_rid", "_session", "_order", code.alias("_code"), F.when(code.isNull(), F.col("_placed")).alias("_placed")), "json-found")
    spans = found.where("_code is null").select("_rid", F.col("_session").alias("session_id"), "_order", F.explode("_placed").alias("s")).select("_rid", "session_id", "_order", "s.*")
    vault = materialize(build_vault(spans.select("session_id", "entity_type", "value_kind", "original", F.struct("_order", "scalar", "start").alias("at")), secret, nonce), "vault")
    filled = spans.join(vault.select("session_id", "entity_type", "value_kind", "original", F.col("token").alias("put")), ["session_id", "entity_type", "value_kind", "original"])
    # rows of one id have equal payloads; where their spans aren't, none of them has an answer
    same = found.groupBy("_rid").agg(F.max("_code").alias("_failed"), F.count_distinct(F.hash("_placed"), F.xxhash64("_placed")).alias("_ways"), F.max(F.size("_placed")).alias("_wanted"))
    named = same.join(_put_arrays(filled.withColumn("number", F.lit(False))), "_rid", "left")
    whole = (F.col("_ways") == 1) & F.coalesce(F.size("_puts") == F.col("_wanted"), F.lit(False))
    named = materialize(named.select("_rid", F.coalesce("_failed", F.when(~whole, "TRANSFORMATION_CONFLICT")).alias("_failed"), "_puts"), "json-puts")
    return _put_back(df, named, key, session, text, strict, out), vault


def _put_arrays(hits: DataFrame) -> DataFrame:
    fields = ["scalar", "start", "end", "put", "number"]
    return hits.select("_rid", *fields).distinct().groupBy("_rid").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("_puts"))


def _put_back(df: DataFrame, named: DataFrame, key: str, session: str, text: str, strict: bool, out: str) -> DataFrame:
    """Rows of ``df`` with the replacements of ``named`` (_rid, _failed, _puts) in their payloads."""
    rest = [c for c in df.columns if c != text]
    held = df.select(F.struct(F.lit(True).alias("_is"), *(F.col(f"`{c}`") for c in rest)).alias("_row"), F.col(text).alias("_text"), F.when(F.col(text).isNotNull(), row_id(key, session, text)).alias("_rid"))
    held = _through(held.join(fitted(named), "_rid", "left"), ["_text", "_puts"], _put_scalars, {"_payload": ("string", pa.string()), "_mode": ("string", pa.string()), "_lost": ("string", pa.string())})
    new = F.struct(F.col("_payload").alias("payload"), F.col("_lost").alias("code"))
    return _written(held.withColumn("_new", new), _given(df, text), "_mode", F.col("_failed"), strict, out)


def _written(df: DataFrame, given: Sequence[Column], mode: str, failed: Column, strict: bool, out: str) -> DataFrame:
    refused = F.when(F.lit(strict) & (F.col(mode) == "text"), "TRANSFORMATION_CONFLICT")
    code = F.coalesce(failed, refused, F.col("_new.code"))
    return df.select(*given, F.when(code.isNull(), F.col("_new.payload")).alias(out), F.col(mode).alias("mode"), code.alias("failure_code"))


def restore_json(df: DataFrame, vault: DataFrame, key: str, session: str, text: str = "text", out: str = "restored", allowed: Sequence[str] | None = None) -> DataFrame:
    """A string that is a whole token regains its typed value, tokens inside strings and names become text."""
    some = df.where(F.contains(F.col(text), F.lit("[[PII_"))).select(row_id(key, session, text).alias("_rid"), F.col(session).cast("string").alias("session_id"), F.col(text).alias("_text"))
    some = list_scalars(some, "_text").drop("_text")
    one = some.select("_rid", "session_id", F.posexplode("_scalars").alias("scalar", "s")).where("s.kind = 'string' and contains(s.value, '[[PII_')")
    at = one.select("_rid", "session_id", "scalar", F.explode(match_spans(F.col("s.value"), TOKEN)).alias("m")).select("_rid", "session_id", "scalar", F.col("m.start").alias("start"), F.col("m.end").alias("end"), F.col("m.value").alias("token"))
    hits = at.join(allowed_vault(vault, allowed).select("session_id", "token", F.col("original").alias("put"), (F.col("value_kind") == "number").alias("number")), ["session_id", "token"])
    named = materialize(_put_arrays(hits).withColumn("_failed", F.lit(None).cast("string")), "json-puts")
    return _put_back(df, named, key, session, text, False, out)
