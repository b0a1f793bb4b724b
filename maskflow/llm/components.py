"""Connected components of an edge table by alternating large-star and small-star rounds.

Every round is a grouped minimum (pre-aggregated before its shuffle) and a join by node and salt, so that the rows of
one node with very many neighbours are dealt to SALTS tasks, whatever the session's settings; each round is written
to the shared folder, so a lost executor costs no more than one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Tasks among which the edges of one node are dealt.
SALTS = 16


def with_least(edges: DataFrame, least: DataFrame) -> DataFrame:
    """Edges (u, v) with the column ``low`` of their u's row in ``least`` (u, low)."""
    salted = edges.withColumn("_salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
    return salted.join(least.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["u", "_salt"]).drop("_salt")


def components(edges: DataFrame, tag: str = "components") -> DataFrame:
    """(a long, b long) edges -> (node, label): label is the smallest node of the component.

    Null ends and loops are ignored; nodes without an edge to another don't appear.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = materialize(edges, tag)
    seen = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
        # large star: every greater neighbour of u points at u's least neighbour
        large = with_least(both, low).where("v > u and v > low").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()
        # small star: u and its lesser neighbours point at the least of these
        least = large.groupBy("u").agg(F.min("v").alias("low"))
        small = with_least(large, least).where("v > low").select(F.col("v").alias("u"), F.col("low").alias("v")).union(least.select("u", F.col("low").alias("v"))).distinct()
        edges = materialize(small, tag)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.max("u")).first()
        if seen == now:
            break
        seen = now
    # at rest every edge (u, v) is (node, least node of its component)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
