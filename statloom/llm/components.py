"""Connected components of a link table, with joins and aggregates only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.llm.common import cut, discard


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(node, root)`` for every node of ``links(a, b)``: root is the least node that links lead to.

    Each round a node takes the least root among its own and its neighbours',
    and then its root's root, so that distances shrink by halves. Minima are
    combined before the shuffle; a node with very many links is split by the
    join. Every round ends in a table in the shared folder, and only the number
    of changed roots comes to the driver. Self-links give their node alone; an
    empty table gives an empty one.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = cut(both.where("a IS NOT NULL AND b IS NOT NULL").distinct(), "edges")
    roots = cut(edges.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("root"), F.lit(True).alias("moved")), "roots")
    for _ in range(max_rounds):
        near = edges.join(roots.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        step = roots.join(near, "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        up = step.select(F.col("node").alias("root"), F.col("root").alias("top"))
        jumped = step.join(up, "root").select("node", F.least("root", "top").alias("root"), (F.least("root", "top") != F.col("old")).alias("moved"))
        new = cut(jumped, "roots")
        discard(roots)
        roots = new
        if not roots.where("moved").limit(1).count():
            discard(edges)
            out = roots.select("node", "root")
            out._scratch_path = roots._scratch_path
            return out
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
