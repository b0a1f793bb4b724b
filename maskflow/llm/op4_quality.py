"""Quality rules: a threshold table compiled into one projection of built-in expressions.

A rule bounds a count by a percentage of another, in whole numbers, so that every engine agrees on ties. The
measures (length, symbols, stop words, lines, repeated word windows) are array and string functions of the row
alone: no shuffle, no user function.

Defined cases: null text has no words and no lines (all counts 0, base_failed, not kept); an empty table gives no
rows; repeated rows are judged each; extra columns are ignored, but for those named in ``keep``: these are passed on,
and one that has the name of a measure or verdict is an error.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, spread

#: Frequent function words of English, German, French and Spanish; they count with a capital, too.
STOP_WORDS = (
    "the of and to in that is it for with as was by on are be at or from this "
    "der die und das zu den von mit nicht ist des im für auf ein eine dem sich auch "
    "le la les de et des un une en du que qui dans pour pas au sur est avec "
    "el los las y del se por con una su para como más o pero"
).split()
SYMBOLS = "#*$%&|<>"
_SPACE = "[\\\\x20\\\\x09-\\\\x0D]"


@dataclass(frozen=True)
class Rule:
    """100 * ``count`` is at least (or at most) ``percent`` * ``of``."""

    name: str
    count: str
    percent: int
    of: str
    at_least: bool = False

    def sql(self) -> str:
        return f"100 * {self.count} {'>=' if self.at_least else '<='} {self.percent} * {self.of}"


BASE = (Rule("enough_words", "n_words", 50 * 100, "1", at_least=True), Rule("few_repeated_windows", "n_repeat_words", 50, "n_words"))
RULES = (
    Rule("words_not_too_short", "word_chars", 200, "n_words", at_least=True),
    Rule("words_not_too_long", "word_chars", 1600, "n_words"),
    Rule("few_symbols", "n_symbols", 25, "n_words"),
    Rule("stop_words", "n_stop_words", 5, "n_words", at_least=True),
    Rule("few_repeated_lines", "n_dup_lines", 50, "n_lines"),
)


#: The columns that ``judge`` makes.
OWN = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stop_words", "n_lines", "base_failed", "kept", "failed_rules")


def measure(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (doc_id) and the measures of each text."""
    keep = keep or ["doc_id"]
    if clash := sorted({c.lower() for c in keep} & set(OWN)):
        raise ValueError(f"columns that this operator makes itself can't be kept: {clash}")
    text = "coalesce(text, '')"
    words = docs.select(*keep, F.expr(text).alias("_text"), F.expr(f"array_remove(split({text}, '{_SPACE}+'), '')").alias("_words"))
    # windows of three words as 64-bit hashes; most texts repeat none, and only the others look for where
    grams = words.withColumn("_grams", _grams())
    lines = "filter(split(_text, '\\\\n'), x -> x rlike '[^\\\\x20\\\\x09-\\\\x0D]')"
    measured = grams.select(
        *keep,
        F.expr("cast(size(_words) as bigint)").alias("n_words"),
        F.expr("cast(length(concat_ws('', _words)) as bigint)").alias("word_chars"),
        F.expr(f"cast(length(_text) - length(translate(_text, '{SYMBOLS}', '')) as bigint)").alias("n_symbols"),
        F.expr(f"cast(size(filter(_words, w -> w in ({_stop_list()}))) as bigint)").alias("n_stop_words"),
        F.expr(lines).alias("_lines"),
        F.when(F.expr("size(_grams) > size(array_distinct(_grams))"), F.sort_array(F.arrays_zip(F.col("_grams").alias("gram"), F.expr("sequence(0, size(_grams) - 1)").alias("at")))).alias("_sorted"),
    )
    ranked = F.arrays_zip(F.col("_sorted").alias("a"), F.expr("slice(_sorted, 2, size(_sorted) - 1)").alias("b"))
    equal = F.filter(ranked, lambda x: x["a"]["gram"] == x["b"]["gram"])
    twice = measured.withColumn("_twice", F.array_distinct(F.flatten(F.transform(equal, lambda x: F.array(x["a"]["at"], x["b"]["at"])))))
    return twice.select(
        *keep,
        "n_words",
        "word_chars",
        "n_symbols",
        F.expr("cast(size(_lines) - size(array_distinct(_lines)) as bigint)").alias("n_dup_lines"),
        F.expr("cast(coalesce(size(array_distinct(concat(_twice, transform(_twice, x -> x + 1), transform(_twice, x -> x + 2)))), 0) as bigint)").alias("n_repeat_words"),
        "n_stop_words",
        F.expr("cast(size(_lines) as bigint)").alias("n_lines"),
    )


def _stop_list() -> str:
    return ", ".join(f"'{w}'" for w in sorted({*STOP_WORDS, *(w.capitalize() for w in STOP_WORDS)}))


def _grams() -> Column:
    w = F.col("_words")
    n = F.size(w)
    later = [F.slice(w, k, F.greatest(n - (k - 1), F.lit(0))) for k in (2, 3)]
    zipped = F.arrays_zip(w.alias("a"), later[0].alias("b"), later[1].alias("c"))
    return F.transform(F.slice(zipped, 1, F.greatest(n - 2, F.lit(0))), lambda x: F.xxhash64(x["a"], x["b"], x["c"]))


def verdict(rules: tuple[Rule, ...]) -> Column:
    return F.expr(" and ".join(f"({r.sql()})" for r in rules))


def judge(docs: DataFrame, base: tuple[Rule, ...] = BASE, rules: tuple[Rule, ...] = RULES, keep: list[str] | None = None) -> DataFrame:
    """``measure`` and base_failed, kept, and failed_rules (names)."""
    measured = measure(docs, keep)
    failed = F.filter(F.array(*(F.when(~F.expr(r.sql()), F.lit(r.name)) for r in (*base, *rules))), lambda x: x.isNotNull())
    return measured.withColumns({"base_failed": ~verdict(base), "kept": verdict(base) & verdict(rules), "failed_rules": failed})


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spread(read_table(spark, sf_dir, "documents").select("doc_id", "text"))).withColumn("failed_rules", F.concat_ws(",", "failed_rules"))


def _oracle() -> str:
    words = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"
    names = ", ".join(f"CASE WHEN NOT ({r.sql()}) THEN '{r.name}' END" for r in (*BASE, *RULES))
    both, all_rules = (" AND ".join(f"({r.sql()})" for r in x) for x in (BASE, (*BASE, *RULES)))
    return f"""
WITH w AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, {words} AS ws FROM documents),
g AS (SELECT rid, i, concat_ws(' ', ws[i], ws[i + 1], ws[i + 2]) AS gram FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS n FROM g) WHERE n > 1),
c AS (SELECT rid, count(DISTINCT i + k) AS n_repeat_words FROM r, (VALUES (0), (1), (2)) AS t(k) GROUP BY rid),
m AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
    (length(text) - length(translate(text, '{SYMBOLS}', '')))::BIGINT AS n_symbols,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
    len(list_filter(ws, lambda w: w IN ({_stop_list()})))::BIGINT AS n_stop_words, len(ls)::BIGINT AS n_lines
  FROM (SELECT *, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM w) LEFT JOIN c USING (rid))
SELECT *, NOT ({both}) AS base_failed, {all_rules} AS kept, concat_ws(',', {names}) AS failed_rules FROM m"""


QUERIES = {"op4_quality": op4_quality}
ORACLE = {"op4_quality": _oracle()}
