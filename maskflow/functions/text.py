"""Column expressions over text and spans. Offsets are 0-based code points, half-open."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN = "struct<start:int,end:int,entity_type:string>"
EVIDENCE = "struct<start:int,end:int,provider:string,entity_type:string,score:double>"


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that are evaluated once a row, however often later columns use them.

    The optimizer would copy a projected expression into each of its uses; it doesn't look through a generator, so
    the values go through one that gives a single row.
    """
    kept = [c for c in df.columns if c not in columns]
    return df.select(*(F.col(f"`{c}`") for c in kept), F.inline(F.array(F.struct(*(v.alias(k) for k, v in columns.items())))))


def literal(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def is_blank(text: Column) -> Column:
    """Null, or nothing but white space."""
    return text.isNull() | text.rlike(r"\A\p{javaWhitespace}*\z")


def utf16_length(text: Column) -> Column:
    return (F.length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def slice_text(text: Column, start: Column, end: Column) -> Column:
    return F.substring(text, start + 1, end - start)


#: Elements that one step of a scan folds; appending to an array copies it, so a fold over all would be quadratic.
_FOLD = 128
#: Spans of a text from which on it is cut into characters once, instead of being searched from its start for each.
MANY = 64


def let(value: Column, body: Callable[[Column], Column] | str) -> Column:
    """``body`` of a value that is evaluated once: a function, or (cheaper to build) the text of a SQL lambda."""
    inner = F.expr(body) if isinstance(body, str) else None
    return (F.transform(F.array(value), body) if inner is None else F.call_function("transform", F.array(value), inner))[0]


def scan_sql(values: str, zero: int, op: str) -> str:
    """SQL: for each element of an array of integers, ``op`` (of {a} and {b}) over those before it, in n * _FOLD steps and
    not n * n."""

    def fold(xs: str, begin: str) -> str:
        step = op.format(a="acc.at", b="v")
        return f"aggregate({xs}, named_struct('at', {begin}, 'out', cast(array() as array<int>)), (acc, v) -> named_struct('at', {step}, 'out', concat(acc.out, array(acc.at))), acc -> acc.out)"

    pieces = f"transform(sequence(0, cast(greatest(size(xs) - 1, 0) div {_FOLD} as int)), c -> slice(xs, c * {_FOLD} + 1, {_FOLD}))"
    sums = f"transform(ps, p -> aggregate(p, {zero}, (t, v) -> {op.format(a='t', b='v')}))"
    return f"transform(array({values}), xs -> transform(array({pieces}), ps -> flatten(zip_with(ps, {fold(sums, str(zero))}, (p, b) -> {fold('p', 'b')})))[0])[0]"


def scan_before(values: Column, zero: int, op: str) -> Column:
    """The same as a column; ``op`` is SQL of {a} and {b}."""
    return let(values, "given -> " + scan_sql("given", zero, op))


_SPANS = f"""m -> transform(array(zip_with(slice(m.between, 1, size(m.found)), m.found, (g, f) -> named_struct('gap', length(g), 'value', f))), both ->
  zip_with(both, {scan_sql("transform(both, x -> x.gap + length(x.value))", 0, "{a} + {b}")}, (x, at) -> named_struct('start', at + x.gap, 'end', at + x.gap + length(x.value), 'value', x.value)))[0]"""


def match_spans(text: Column, pattern: str) -> Column:
    """array<struct<start,end,value>> of the matches of ``pattern``, none empty.

    The pieces between matches and the matches take turns, so sums of their lengths give every offset.
    """
    found = F.struct(F.split(text, pattern, -1).alias("between"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"))
    # most texts have no match: one cheap search spares them the split
    return F.when(text.rlike(pattern), let(found, _SPANS)).otherwise(F.array().cast("array<struct<start:int,end:int,value:string>>"))


_CHARACTERS = "regexp_extract_all(r.text, '(?s).', 0)"
_CUT = f"""r -> case when size(r.spans) > {MANY} then transform(array({_CHARACTERS}), ch -> transform(r.spans, x -> array_join(slice(ch, x.start + 1, x.`end` - x.start), '')))[0]
  else transform(r.spans, x -> substring(r.text, x.start + 1, x.`end` - x.start)) end"""
_BEFORE, _LAST = "case when i = 0 then 0 else r.spans[i - 1].`end` end", "element_at(r.spans, -1).`end`"
_REPLACE = f"""r -> case when size(r.spans) = 0 then r.text
  when size(r.spans) > {MANY} then transform(array({_CHARACTERS}), ch -> concat(
    array_join(transform(r.spans, (x, i) -> concat(array_join(slice(ch, {_BEFORE} + 1, x.start - {_BEFORE}), ''), x.put)), ''), array_join(slice(ch, {_LAST} + 1, greatest(size(ch) - {_LAST}, 0)), '')))[0]
  else concat(array_join(transform(r.spans, (x, i) -> concat(substring(r.text, {_BEFORE} + 1, x.start - {_BEFORE}), x.put)), ''), substring(r.text, {_LAST} + 1, length(r.text))) end"""


def cut_spans(text: Column, spans: Column) -> Column:
    """The text of each span."""
    return let(F.struct(text.alias("text"), spans.alias("spans")), _CUT)


def replace_spans(text: Column, spans: Column) -> Column:
    """``text`` with each span (ordered, disjoint) replaced by its field ``put``."""
    return let(F.struct(text.alias("text"), spans.alias("spans")), _REPLACE)


def subtract_ranges(spans: Column, ranges: Column) -> Column:
    """What is left of each span (struct with start, end) outside ``ranges`` (ordered, disjoint)."""

    def left(span: Column) -> Column:
        hits = F.filter(ranges, lambda r: (r["start"] < span["end"]) & (r["end"] > span["start"]))
        starts = F.concat(F.array(span["start"]), F.transform(hits, lambda r: r["end"]))
        ends = F.concat(F.transform(hits, lambda r: r["start"]), F.array(span["end"]))
        pieces = F.zip_with(starts, ends, lambda a, b: span.withField("start", F.greatest(a, span["start"])).withField("end", F.least(b, span["end"])))
        return F.filter(pieces, lambda p: p["start"] < p["end"])

    return F.flatten(F.transform(spans, left))


def luhn(candidate: Column) -> Column:
    """Whether the digits of a card number carry their check digit."""
    return F.call_function("luhn_check", candidate)
