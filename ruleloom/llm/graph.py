"""Connected components of a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ruleloom.llm.common import written


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """(node, label) for every node of ``edges`` (u long, v long) that has another
    one; the label is the smallest node of its component.

    In each round every node takes its smallest neighbour for a parent, if that is
    smaller than itself; parents are followed to their roots, twice as far each
    time; then links between roots are all that is left. At least every other
    node of these goes with each round, so that rounds grow with the logarithm of
    the nodes and what they hold shrinks. At the end labels go back down the
    rounds. All steps are joins and partial minima: a node with very many
    neighbours is split by the skewed-join rule and summed up map-side. What a
    round leaves is written to the shared folder.
    """
    def links_of(u: str, v: str, rows: DataFrame) -> DataFrame:
        return written(rows.where(F.col(u) != F.col(v)).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct())

    links, levels = links_of("u", "v", edges), []
    while not links.isEmpty():
        if len(levels) == most:
            raise RuntimeError(f"components did not settle in {most} rounds")
        ends = links.select(F.col("u").alias("node"), F.col("v").alias("other")).union(links.select("v", "u"))
        parents = written(ends.groupBy("node").agg(F.least("node", F.min("other")).alias("parent")))
        moved = True
        while moved:
            above = parents.select(F.col("node").alias("parent"), F.col("parent").alias("top"))
            step = written(parents.join(above, "parent").select("node", F.col("top").alias("parent"), (F.col("top") != F.col("parent")).alias("moved")))
            moved = not step.where("moved").isEmpty()
            parents = step.select("node", "parent")
        levels.append(parents)
        of_u, of_v = (parents.select(F.col("node").alias(end), F.col("parent").alias(root)) for end, root in (("u", "a"), ("v", "b")))
        links = links_of("a", "b", links.join(of_u, "u").join(of_v, "v"))
    if not levels:
        return links.select(F.col("u").alias("node"), F.col("v").alias("label"))
    labels = levels.pop()
    for parents in reversed(levels):
        above = labels.select(F.col("node").alias("parent"), F.col("parent").alias("top"))
        labels = parents.join(above, "parent", "left").select("node", F.coalesce("top", "parent").alias("parent"))
    return written(labels.withColumnRenamed("parent", "label"))
