"""Connected components of an edge table by contraction, without a driver-side graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparquill.llm.common import discard, few_files, written


def components(edges: DataFrame) -> DataFrame:
    """(a, b) pairs to (node, root): root is one node of the component, the same for all of it.

    Each round points every node at the first of itself and its neighbours, in
    an order that a hash draws anew each round, and replaces both ends of each
    edge by what they point at. Edges inside one group vanish. In a drawn order
    a fixed share of the nodes, on average, is pointed at by none, whatever the
    shape of the graph, so the number of rounds is logarithmic; in the order of
    values a chain of ascending nodes would lose one a round. Grouping is by
    node with partial aggregation; the joins look up one row per node, so a hub
    only makes its side of the join longer, which adaptive execution can split.
    Null ends and loops are ignored; no edges give an empty table.
    """
    edges = written(edges.select("a", "b").filter("a <> b").distinct())
    labels, known, nodes, turn = None, None, 0, 0
    while n := edges.count():
        nodes = nodes or 2 * n  # at most, of all that have edges
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        drawn = [F.struct(F.xxhash64(c, F.lit(turn)).alias("draw"), F.col(c).alias("node")) for c in ("a", "b")]
        first = both.groupBy("a").agg(F.min(drawn[1]).alias("m")).withColumn("m", F.least(drawn[0], "m"))
        up = written(few_files(first.select(F.col("a").alias("k"), F.col("m")["node"].alias("p")), 2 * n))
        turn += 1
        if labels is None:
            known, labels = up, up.select(F.col("k").alias("node"), F.col("p").alias("root"))
        else:
            new = written(few_files(labels.join(up, labels.root == up.k, "left").select("node", F.coalesce("p", "root").alias("root")), nodes))
            discard(known)
            known = labels = new
        one = up.select(F.col("k").alias("a"), F.col("p").alias("pa"))
        two = up.select(F.col("k").alias("b"), F.col("p").alias("pb"))
        left = edges.join(one, "a").join(two, "b").filter("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b"))
        left = written(few_files(left.distinct(), n))
        discard(edges, *(() if known is up else (up,)))
        edges = left
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return labels
