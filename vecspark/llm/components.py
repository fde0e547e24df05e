"""Connected components by contraction: every node takes its least neighbour's label until no edge is left."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecspark.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of `edges` (u, v: never null); the root is the component's least node.

    A round maps each node to the least of itself and its neighbours, twice
    over, and relabels the edges; edges inside one label vanish. Labels that
    do not depend on the graph's shape, such as hashes, shrink it by a
    constant factor a round. Each round is written, which cuts the lineage;
    nothing is gathered on the driver but whether edges remain. An empty
    table of edges gives an empty result.
    """
    edges = written(edges.where("u <> v").select("u", "v").distinct(), "edges")
    maps: list[DataFrame] = []
    while not edges.isEmpty():
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        once = written(both.groupBy("u").agg(F.least("u", F.min("v")).alias("to")), "labels")
        again = once.select(F.col("u").alias("to"), F.col("to").alias("next"))
        step = written(once.join(again, "to").select("u", F.col("next").alias("to")), "labels")
        maps.append(step)
        left = step.select("u", F.col("to").alias("a"))
        right = step.select(F.col("u").alias("v"), F.col("to").alias("b"))
        moved = edges.join(left, "u").join(right, "v").where("a <> b")
        edges = written(moved.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct(), "edges")
    if not maps:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    labels = maps[0].select(F.col("u").alias("node"), F.col("to").alias("root"))
    for step in maps[1:]:
        labels = labels.join(step.select(F.col("u").alias("root"), "to"), "root", "left").select(
            "node", F.coalesce("to", "root").alias("root")
        )
    return labels
