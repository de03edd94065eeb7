"""Connected components by alternating large-star and small-star steps over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelnet.operators.settle import discard, even_join, stored


def _state(e: DataFrame) -> tuple:
    """What changes with any edge: the number of edges and two hashes of them, which cannot overflow."""
    return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a", F.lit(1)))).first())


def _large_star(e: DataFrame, total: int) -> DataFrame:
    """Every node links its larger neighbours to the least of itself and its neighbours."""
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n")
    return even_join(both, least, "a", 2 * total).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(e: DataFrame, total: int) -> DataFrame:
    """Every node links itself and its smaller neighbours to the least of them; e runs from larger to smaller."""
    least = e.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    onward = even_join(e, least, "a", total).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return onward.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """edges(a, b) of integers -> (node, component), the component being its least node.

    Nodes without an edge to another node are absent. Null ends and loops are ignored, repeated edges
    count once, an empty table gives an empty result. Each round is written to the shared folder, so a
    lost executor costs at most one round; rounds grow with the logarithm of the longest chain, and go on
    until no edge changes. Nodes with very many neighbours are joined apart (even_join).
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = stored(e, "cc")
    state = _state(e)
    while state[0]:
        wide = stored(_large_star(e, state[0]), "cc")
        after = stored(_small_star(wide, state[0]), "cc")
        discard(wide, e)
        e, before, state = after, state, _state(after)
        if state == before:
            break
    roots = e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
