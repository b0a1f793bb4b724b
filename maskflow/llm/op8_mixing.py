"""Mixing sources to target weights by hierarchical budgets, with built-in functions only.

The tree is domain > language > source; a leaf is a (domain, lang, source). A token budget goes down level by level:
children share their parent's budget by weight, none gets more than its leaves can supply in ``epochs`` passes, and
what a child can't take goes to its siblings (the level fills up like water). As a node never asks for more than it
can supply, a shortage reaches an ancestor's siblings only when its own siblings are full.

A leaf takes whole passes while its budget lasts, then a prefix of one seeded pass: documents in the order of a
digest of (seed, pass, doc_id, text) until the budget is used; of the last document a prefix of its tokens.

Scale: token sums are grouped by leaf, then by leaf and 4096 ranges of the digest. The one range in which a leaf's prefix
ends is found digit by digit (16 sums a leaf at a time), and only its documents are put in order, so a leaf that holds a
third of all rows never is. The cut of each leaf is a
digest, and rows are kept by comparing with it: texts are never shuffled.

Defined cases: null domain, lang or source is a value ``(none)`` of its own; null text has no tokens; documents
without tokens are taken where the prefix passes them; rows equal in doc_id and text share a place and are taken
together; a weight of 0 leaves a node out (its share goes to its siblings), a negative one is an error; empty table: no rows; budgets are rounded down at each node (less than one token a child is lost).
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, read_table

LEVELS = ("domain", "lang", "source")
#: Hexadecimal digits of a digest that make its range.
DIGITS = 3


@dataclass(frozen=True)
class Mix:
    """Weights of nodes by name at each level (1 if not named), budget in percent of all tokens, passes at most."""

    weights: dict[str, dict[str, int]] = field(default_factory=lambda: {"domain": {"d0": 4, "d1": 3, "d2": 2, "d3": 1}, "lang": {"en": 5, "de": 2, "fr": 2, "es": 1}, "source": {}})
    percent: int = 60
    epochs: int = 2
    seed: int = 42
    #: SQL expression of a document's domain.
    domain: str = "concat('d', cast(nullif(regexp_extract(source, '[0-9]+', 0), '') as int) % 4)"

    def __post_init__(self) -> None:
        if any(w < 0 for names in self.weights.values() for w in names.values()) or self.percent < 0 or self.epochs < 0:
            raise ValueError("weights, percent and epochs can't be negative")

    def closed(self, level: str) -> list[str]:
        """Names of weight 0 at a level: what lies under them is left out, and its share goes to the siblings."""
        return sorted(k for k, w in self.weights.get(level, {}).items() if w == 0)


def _named(column: Column, names: dict[str, int]) -> Column:
    out = F.lit(1)
    for name, weight in names.items():
        out = F.when(column == name, F.lit(max(weight, 1))).otherwise(out)  # a node of weight 0 has no supply
    return out.cast("long")


def _with_leaf(docs: DataFrame, mix: Mix) -> DataFrame:
    """doc_id, n_tokens (words), digest of the text, and the leaf, under names that no input column has."""
    text = "coalesce(text, '')"
    return docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"),  # whatever its columns are called
        "doc_id",
        F.expr(f"cast(size(array_remove(split({text}, '[\\\\x20\\\\x09-\\\\x0D]+'), '')) as bigint)").alias("_n"),
        F.md5(F.expr(text)).alias("_text"),
        F.expr(f"coalesce({mix.domain}, '(none)')").alias("_domain"),
        F.coalesce("lang", F.lit("(none)")).alias("_lang"),
        F.coalesce("source", F.lit("(none)")).alias("_source"),
    )


def _key(mix: Mix, epoch: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(mix.seed)), epoch.cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("_text")))


def _share(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Adds ``budget`` to nodes (parent columns, name, supply, weight, above): above shared by weight, at most supply each."""
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    by = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    line = by.orderBy(F.col("supply") / F.col("weight"), name)
    nodes = nodes.withColumns(
        {"k": F.row_number().over(line), "filled": (F.sum("supply").over(line) - F.col("supply")).cast("long"), "open": (F.sum("weight").over(by) - F.sum("weight").over(line) + F.col("weight")).cast("long")}
    )
    full = wide("supply") * wide("open") <= (wide("above") - wide("filled")) * wide("weight")
    nodes = nodes.withColumn("first_open", F.min(F.when(~full, F.col("k"))).over(by))
    at = F.when(F.col("k") == F.col("first_open"), F.struct("filled", "open"))
    nodes = nodes.withColumn("level", F.max(at).over(by))
    water = F.expr("cast(((cast(above as decimal(38,0)) - level.filled) * weight) div level.open as bigint)")
    return nodes.withColumn("budget", F.when(F.col("first_open").isNull() | (F.col("k") < F.col("first_open")), F.col("supply")).otherwise(water)).drop("k", "filled", "open", "first_open", "level")


def budgets(supply: DataFrame, mix: Mix) -> DataFrame:
    """(_domain, _lang, _source, tokens of one pass) of each leaf -> budget, passes (whole ones) and rest (of the next)."""
    columns = [f"_{level}" for level in LEVELS]
    out = reduce(or_, (F.col(c).isin(mix.closed(name)) if mix.closed(name) else F.lit(False) for c, name in zip(columns, LEVELS, strict=True)))
    supply = supply.withColumn("open", F.when(out, F.lit(0)).otherwise(F.col("tokens")).cast("long"))
    level = supply.groupBy(columns[0]).agg(F.sum("open").alias("supply"), F.sum("tokens").alias("tokens"))  # a row for each domain
    level = level.withColumn("above", F.expr(f"sum(tokens) over () * {mix.percent} div 100")).drop("tokens")
    for k, column in enumerate(columns):
        if k:
            down = level.select(*columns[:k], F.col("budget").alias("above"))
            level = supply.groupBy(*columns[: k + 1]).agg(F.sum("open").alias("supply")).join(down, columns[:k])
        level = level.withColumns({"supply": F.col("supply") * mix.epochs, "weight": _named(F.col(column), mix.weights.get(LEVELS[k], {}))})
        level = _share(level, columns[:k], column)
    return level.join(supply, columns).select(*columns, "tokens", "budget", F.expr("cast(case when tokens > 0 then budget div tokens else 0 end as int)").alias("passes"), F.expr("case when tokens > 0 then budget % tokens else 0 end").alias("rest"))


def last_ranges(sums: DataFrame, columns: list[str]) -> DataFrame:
    """Of the digest ranges (columns, rest, range, n) of each leaf, the one in which its rest is used up, with ``before``,
    the tokens of earlier ones. It is found digit by digit, so no window holds more than 16 rows of a leaf."""
    inside = sums.withColumn("before", F.lit(0).cast("long"))
    for digits in range(1, DIGITS + 1):
        wide = F.substring("range", 1, digits)
        steps = inside.groupBy(*columns, "rest", "before", wide.alias("range")).agg(F.sum("n").alias("n"))
        upto = F.sum("n").over(Window.partitionBy(*columns).orderBy("range"))
        steps = steps.withColumn("before", F.col("before") + upto - F.col("n"))
        last = steps.where("before < rest and rest <= before + n").select(*columns, "range", "before")
        if digits < DIGITS:
            inside = sums.withColumn("_wide", wide).join(last.withColumnRenamed("range", "_wide"), [*columns, "_wide"]).drop("_wide")
    return last


def mix_documents(docs: DataFrame, mix: Mix) -> DataFrame:
    """The rows of ``docs`` that are taken, as struct _row, once for each pass; with _epoch, _taken (tokens of it), _n and
    the leaf."""
    columns = [f"_{level}" for level in LEVELS]
    marked = _with_leaf(docs, mix)
    small = materialize(marked.select("doc_id", "_n", "_text", *columns), "op8-rows")
    leaves = materialize(budgets(small.groupBy(*columns).agg(F.sum("_n").alias("tokens")), mix), "op8-leaves")
    ordered = small.join(leaves.where("rest > 0").select(*columns, "passes", "rest"), columns).withColumn("key", _key(mix, F.col("passes")))
    part = F.substring("key", 1, DIGITS).alias("range")
    sums = materialize(ordered.groupBy(*columns, "rest", part).agg(F.sum("_n").alias("n")), "op8-sums")
    last = materialize(last_ranges(sums, columns), "op8-ranges")
    ending = ordered.withColumn("range", F.substring("key", 1, DIGITS)).join(last, [*columns, "range"])
    sums = ending.groupBy(*columns, "rest", "before", "key").agg(F.sum("_n").alias("n"))
    start = F.col("before") + F.sum("n").over(Window.partitionBy(*columns).orderBy("key")) - F.col("n")
    cuts = sums.withColumn("start", start).where("start < rest").groupBy(*columns).agg(F.max("key").alias("cut"), F.max_by("start", "key").alias("cut_start"))
    plan = materialize(leaves.join(cuts, columns, "left").select(*columns, "passes", "rest", "cut", "cut_start"), "op8-plan")
    taken = marked.join(plan, columns).withColumn("_key", F.when(F.col("cut").isNotNull(), _key(mix, F.col("passes"))))
    partial = F.coalesce(F.col("_key") <= F.col("cut"), F.lit(False))
    times = F.col("passes") + partial.cast("int")
    taken = taken.withColumn("_times", times).where("_times > 0").withColumn("_epoch", F.explode(F.sequence(F.lit(0), F.col("_times") - 1)))
    cut_short = (F.col("_epoch") == F.col("passes")) & (F.col("_key") == F.col("cut"))
    return taken.withColumn("_taken", F.when(cut_short, F.least(F.col("_n"), F.col("rest") - F.col("cut_start"))).otherwise(F.col("_n")))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = mix_documents(read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"), Mix())
    return taken.select("doc_id", F.col("_domain").alias("domain"), F.col("_lang").alias("lang"), F.col("_source").alias("source"), F.col("_epoch").alias("epoch"), F.col("_n").alias("n_tokens"), F.col("_taken").alias("taken_tokens"))


def level_sql(columns: list[str], name: str, above: str, mix: Mix) -> str:
    """SQL of one level: a row for each node with its budget. ``above``: the table with the parents' budgets."""
    parent, node = columns[:-1], columns[-1]
    weight = " ".join(["CASE", *(f"WHEN {node} = '{k}' THEN {max(v, 1)}" for k, v in mix.weights.get(node, {}).items()), "ELSE 1 END"]) if mix.weights.get(node) else "1"
    by = f"PARTITION BY {', '.join(parent)}" if parent else ""
    source = f"(SELECT {', '.join(columns)}, sum(open)::BIGINT * {mix.epochs} AS supply, {weight} AS weight FROM supply GROUP BY {', '.join(columns)}) {'JOIN' if parent else 'CROSS JOIN'} {above}{' USING (' + ', '.join(parent) + ')' if parent else ''}"
    line = f"OVER ({by} ORDER BY supply::DOUBLE / weight, {node})"
    return f"""
{name}1 AS (SELECT *, row_number() {line} AS k, (sum(supply) {line})::HUGEINT - supply AS filled, (sum(weight) OVER ({by}))::HUGEINT - (sum(weight) {line})::HUGEINT + weight AS open FROM {source}),
{name}2 AS (SELECT *, min(CASE WHEN NOT (supply::HUGEINT * open <= (above::HUGEINT - filled) * weight) THEN k END) OVER ({by}) AS first_open FROM {name}1),
{name}3 AS (SELECT *, max(CASE WHEN k = first_open THEN filled END) OVER ({by}) AS f, max(CASE WHEN k = first_open THEN open END) OVER ({by}) AS o FROM {name}2),
{name} AS (SELECT {', '.join(columns)}, CASE WHEN first_open IS NULL OR k < first_open THEN supply ELSE ((above::HUGEINT - f) * weight // o)::BIGINT END AS above FROM {name}3)"""


def mixing_sql(mix: Mix, documents: str, domain: str) -> str:
    """SQL whose table ``taken`` has a row for each taken document and pass."""
    leaf = "domain, lang, source"
    closed = [f"{name} = '{k}'" for name in LEVELS for k in mix.closed(name)]
    out = " OR ".join(closed) or "false"
    return f"""
small AS (SELECT *, coalesce({domain}, '(none)') AS domain, coalesce(doc_lang, '(none)') AS lang, coalesce(doc_source, '(none)') AS source,
  len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n_tokens, md5(coalesce(text, '')) AS digest
  FROM (SELECT * RENAME (lang AS doc_lang, source AS doc_source) FROM {documents})),
supply AS (SELECT {leaf}, sum(n_tokens)::BIGINT AS tokens, CASE WHEN {out} THEN 0 ELSE tokens END AS open FROM small GROUP BY {leaf}),
root AS (SELECT coalesce(sum(tokens), 0)::BIGINT * {mix.percent} // 100 AS above FROM supply),
{level_sql(["domain"], "la", "root", mix)}, {level_sql(["domain", "lang"], "lb", "la", mix)}, {level_sql(["domain", "lang", "source"], "lc", "lb", mix)},
leaves AS (SELECT {leaf}, tokens, CASE WHEN tokens > 0 THEN above // tokens ELSE 0 END AS passes, CASE WHEN tokens > 0 THEN above % tokens ELSE 0 END AS rest FROM lc JOIN supply USING ({leaf})),
keyed AS (SELECT small.*, passes, rest, md5(concat_ws(':', '{mix.seed}', passes::VARCHAR, coalesce(doc_id::VARCHAR, ''), digest)) AS key FROM small JOIN leaves USING ({leaf})),
placed AS (SELECT *, sum(n_tokens) OVER (PARTITION BY {leaf} ORDER BY key RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - sum(n_tokens) OVER (PARTITION BY {leaf}, key) AS start FROM keyed),
taken AS (SELECT *, unnest(range(0, (passes + CASE WHEN start < rest THEN 1 ELSE 0 END)::BIGINT)) AS epoch FROM placed)"""


def _oracle() -> str:
    mix = Mix()
    return f"""WITH {mixing_sql(mix, "documents", "'d' || (nullif(regexp_extract(doc_source, '[0-9]+'), '')::INT % 4)")}
SELECT doc_id, domain, lang, source, epoch::INTEGER AS epoch, n_tokens, CASE WHEN epoch = passes THEN least(n_tokens, rest - start) ELSE n_tokens END::BIGINT AS taken_tokens FROM taken"""


QUERIES = {"op8_mixing": op8_mixing}
ORACLE = {"op8_mixing": _oracle()}
