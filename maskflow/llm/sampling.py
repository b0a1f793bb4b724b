"""Bounded, repeatable samples of labelled rows, the only rows that classifiers are fitted on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize


def fold(doc_id: str | Column, folds: int) -> Column:
    """crc32 of the id's decimal digits, modulo ``folds`` (null for a null id)."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")), F.lit(folds))


#: Bytes of text that a sample holds at most.
SAMPLE_BYTES = 64 << 20


def by_class(rows: DataFrame, label: str, per_class: int, max_classes: int, text: str | None = None) -> DataFrame:
    """About ``per_class`` distinct rows of each class, by a hash of doc_id (and of ``text``, if given), written once.

    The sample never has more than ``2 * per_class`` rows for each class found, nor ``SAMPLE_BYTES`` of ``text``: beyond,
    rows go in the order of their hash. Sizes of classes are distinct ids, counted over all rows by a sketch, so
    repeated ids count once; then each class keeps what hashes below its share, and equal rows are combined before the
    shuffle: no class or id is ever gathered in one task. Only the ``max_classes`` largest classes are kept. Rows whose
    id is null take no part.
    """
    rows = rows.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
    sizes = rows.groupBy(label).agg(F.approx_count_distinct("doc_id").alias("count"))
    counts = sizes.orderBy(F.desc("count"), label).limit(max_classes).collect()  # at most max_classes rows
    if not counts:
        return rows.limit(0)
    key = [F.col("doc_id"), *([F.xxhash64(text)] if text else []), F.lit("sample")]
    share = F.create_map(*(x for c in counts for x in (F.lit(c[label]), F.lit(min(1.0, per_class / max(1, c["count"]))))))
    # in units of the class's share, so that a bound on the whole cuts all classes alike
    at = F.xxhash64(*key).bitwiseAND(F.lit((1 << 32) - 1)) / F.lit(float(1 << 32)) / F.element_at(share, F.col(label))
    some = rows.withColumn("_at", at).where("_at < 1")
    return bounded(some, "_at", 2 * per_class * len(counts), text).drop("_at")


def bounded(rows: DataFrame, order: str, most: int, text: str | None = None, most_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """Distinct ``rows``, the first ``most`` by ``order`` and of these as many as hold ``most_bytes`` of ``text``. Only
    narrow rows are put in order, a top-``most`` of each task at a time."""
    held = materialize(rows.dropDuplicates(), "sample")
    size = F.coalesce(F.octet_length(text), F.lit(0)) if text else F.lit(0)
    n, total = held.agg(F.count("*"), F.sum(size.cast("long"))).first()
    if n <= most and (total or 0) <= most_bytes:
        return held
    first = held.select(order, size.cast("long").alias("_size")).orderBy(order).limit(most)
    upto = F.sum("_size").over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0))  # at most ``most`` rows
    last = first.withColumn("_upto", upto).where(F.col("_upto") <= most_bytes).agg(F.max(order), F.count("*")).first()
    if last[0] is None:
        return held.limit(0)
    kept = held.where(F.col(order) <= F.lit(last[0]))
    return kept if kept.count() <= most else held.orderBy(order).limit(most)  # more rows of one hash than the bound
