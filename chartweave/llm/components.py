"""Connected components of a table of links, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from chartweave.llm.shared import MAX_BROADCAST_KEYS, write_through


def _large_star(edges: DataFrame, hint) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
    return both.join(hint(least), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame, hint) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(hint(least), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v")))


def connected_components(links: DataFrame) -> DataFrame:
    """(vertex, label): the smallest vertex that each linked vertex can reach.

    ``links`` has two columns u and v of one orderable type. Loops, repeated
    links and nulls are left out; an empty table gives an empty result. Vertices
    without links aren't returned. Every round is written to the shared folder, so a lost
    executor costs one task, and rounds grow with the logarithm of the longest chain. The links are
    counted first: few enough, and the table of a vertex each is broadcast, else joined.
    """
    edges = links.select("u", "v").where("u <> v")
    # A link moves but never multiplies, so this bounds the vertices of all rounds.
    few = 2 * edges.limit(MAX_BROADCAST_KEYS).count() < MAX_BROADCAST_KEYS
    hint = F.broadcast if few else lambda table: table
    seen = None
    while True:
        edges = _small_star(_large_star(edges, hint), hint).where("u <> v").distinct()
        edges = write_through(edges, "stars")
        now = edges.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        ).first()
        if now == seen or now[0] == 0:
            break
        seen = now
    tops = edges.select(F.col("v").alias("vertex"), F.col("v").alias("label")).distinct()
    return edges.select(F.col("u").alias("vertex"), F.col("v").alias("label")).unionByName(tops)
