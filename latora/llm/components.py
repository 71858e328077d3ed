"""Connected components of an edge table, by alternating star contraction.

Large-star hangs every larger neighbour of a node on its smallest neighbour; small-star does
so for the smaller ones. Both are a minimum per node (summed on the map side, so a node with
very many links costs one row per task) and a join back to the edges, which the engine may
split where a node is hot. The edges of each round are written to the checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latora.llm.common import checkpointed

MAX_ROUNDS = 60


def _hang(edges: DataFrame, side: str) -> DataFrame:
    """Edges (a, b), a > b, after one star step."""
    if side == "large":
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        out = both.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        least = edges.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        moved = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).join(least, "u").filter("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
        out = moved.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.filter("a > b").distinct()


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x"), F.sum(F.pmod(F.xxhash64("b", "a"), F.lit(1 << 31))).alias("s")).first()
    return row.n, row.x, row.s


def components(links: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(node, root) for every node with a link; root is the smallest node it reaches.

    ``links`` has two long columns. Loops, repeated links, either direction and nulls (which
    link nothing) are allowed; an empty table gives an empty result.
    """
    a, b = F.col(left), F.col(right)
    edges = checkpointed(links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"), (a.isNotNull() & b.isNotNull()).alias("ok")).filter("ok AND a > b").select("a", "b").distinct())
    before = _mark(edges)
    for _ in range(MAX_ROUNDS):
        if not before[0]:
            break
        edges = checkpointed(_hang(_hang(edges, "large"), "small"))
        now = _mark(edges)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
