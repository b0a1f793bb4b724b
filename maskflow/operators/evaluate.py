"""Measuring detection, and probing that nothing leaked."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.storage import materialize
from ..functions.text import cut_spans, match_spans
from ..sources.detect import Detector
from .resolve import analyze
from .rewrite import redact, token_pattern

#: Bytes of query vectors that are broadcast at once.
BLOCK_BYTES = 64 << 20


def score_detection(expected: DataFrame, actual: DataFrame, columns: Sequence[str] = ("doc_id", "entity_type", "original")) -> DataFrame:
    """V1: tp, fp, fn of two multisets of findings; both are counted before they meet, so repeats don't multiply."""
    want = expected.groupBy(*columns).agg(F.count("*").alias("want"))
    have = actual.groupBy(*columns).agg(F.count("*").alias("have"))
    both = want.join(have, list(columns), "full_outer").select(F.coalesce("want", F.lit(0)).alias("want"), F.coalesce("have", F.lit(0)).alias("have"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return both.agg(total(F.least("want", "have")).alias("tp"), total(F.greatest(F.col("have") - F.col("want"), F.lit(0))).alias("fp"), total(F.greatest(F.col("want") - F.col("have"), F.lit(0))).alias("fn"))


def leaks(texts: DataFrame, originals: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """V3: a row for each original value that still stands in its document's text."""
    return texts.join(originals.select(key, "original").distinct(), key).where(F.contains(F.col(text), F.col("original")))


def row_leaks(rows: DataFrame, protected: str, key: str = "doc_id", text: str = "text", spans: str = "spans") -> DataFrame:
    """V3 where text, spans and protected text stand in one row: no join."""
    originals = F.array_distinct(cut_spans(F.col(text), F.col(spans)))
    return rows.select(key, protected, F.explode(originals).alias("original")).where(F.contains(F.col(protected), F.col("original")))


def token_counts(texts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """V4: distinct tokens of each row and type."""
    some = texts.where(F.contains(F.col(text), F.lit("[[PII_")))
    found = some.select(key, F.explode(match_spans(F.col(text), token_pattern())).alias("m")).select(key, F.col("m.value").alias("token"))
    kind = F.regexp_extract("token", r"^\[\[PII_(.+)_[a-f0-9]{32}_[0-9]+\]\]$", 1)
    return found.groupBy(key, kind.alias("entity_type")).agg(F.countDistinct("token").alias("n_tokens"))


def holding(rows: DataFrame, column: str, value: str) -> DataFrame:
    """V5: rows whose column contains a value."""
    return rows.where(F.contains(F.col(column), F.lit(value)))


def active_sessions(sessions: DataFrame) -> int:
    """V6: sessions still open; 0 when a run has cleaned up."""
    return sessions.select("session_id").distinct().count()


def snapshot(rows: DataFrame, columns: Sequence[str] = ("session_id", "tool_name", "input", "output")) -> DataFrame:
    """V7: what a model or a tool was given and gave back."""
    return rows.select(*(c for c in columns if c in rows.columns))


def nearest_rows(queries: DataFrame, vectors: DataFrame, k: int = 1, least: float = 0.9, query_id: str = "query_id", vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """V8: the ``k`` most similar rows of each query, by cosine (ties within 1e-9 to the smaller id), at ``least`` so similar.

    Queries meet all vectors in blocks of BLOCK_BYTES, one scan of the vectors for each; a task multiplies matrices and
    keeps its ``k`` best of each query before the shuffle. Vectors that are null, zero or hold a null take no part.
    """
    whole = f"{vector} is not null and not exists({vector}, x -> x is null) and exists({vector}, x -> x <> 0)"
    queries, vectors = (df.where(whole).select(i, F.col(vector).cast("array<double>").alias("_v")) for df, i in ((queries, query_id), (vectors, vec_id)))
    spark = queries.sparkSession
    result = T.StructType([T.StructField(query_id, queries.schema[query_id].dataType), T.StructField(vec_id, vectors.schema[vec_id].dataType), T.StructField("score", T.DoubleType())])
    found = []
    for dims, n in queries.groupBy(F.size("_v")).count().collect():  # a row for each length of vectors
        blocks = max(1, -(-8 * dims * n // BLOCK_BYTES))
        for block in range(blocks):
            asked = queries.where((F.size("_v") == dims) & (F.pmod(F.xxhash64(query_id), F.lit(blocks)) == block)).toArrow()
            q = asked["_v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            held = spark.sparkContext.broadcast((asked[query_id].combine_chunks(), q / np.sqrt((q * q).sum(1, keepdims=True))))
            found.append(vectors.where(F.size("_v") == dims).mapInArrow(_best(held, dims, k, least, query_id, vec_id), result))
    scored = reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], result)
    rank = F.row_number().over(Window.partitionBy(query_id).orderBy(F.round("score", 9).desc(), vec_id))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def _best(held, dims: int, k: int, least: float, query_id: str, vec_id: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, asks = held.value
        for batch in batches:
            if not batch.num_rows or not len(names):
                continue
            x = batch.column("_v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            x = x / np.sqrt((x * x).sum(1, keepdims=True))
            order = np.argsort(batch.column(vec_id).to_numpy(zero_copy_only=False), kind="stable")
            for at in range(0, len(asks), 1024):
                score = asks[at : at + 1024] @ x[order].T
                top = np.argsort(-score.round(9), axis=1, kind="stable")[:, :k]
                best = np.take_along_axis(score, top, 1)
                row, col = np.nonzero(best >= least)
                yield pa.RecordBatch.from_arrays([names.take(pa.array(at + row)), batch.column(vec_id).take(pa.array(order[top[row, col]])), pa.array(best[row, col])], names=[query_id, vec_id, "score"])

    return run


def retrieve_protected(queries: DataFrame, vectors: DataFrame, texts: DataFrame, detectors: Sequence[Detector], k: int = 1, least: float = 0.9, key: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """V8: ``nearest_rows`` with the text of each row found, redacted before anybody sees it: query_id, vec_id, rank, score,
    protected. Each text is analysed once, however many queries find it."""
    hits = materialize(nearest_rows(queries, vectors, k, least), "hits")
    wanted = hits.select(F.col("vec_id").alias(key)).distinct()
    done = redact(analyze(texts.join(wanted, key, "left_semi"), detectors, text, **settings), text, out="protected")
    return hits.join(done.select(F.col(key).alias("vec_id"), "protected"), "vec_id", "left")
