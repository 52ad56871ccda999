"""Connected components of a link table, by contraction, in Spark alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store


def components(links: DataFrame, name: str = "links") -> DataFrame:
    """u and the smallest node p that links (a, b) connect it to; only nodes that have links.

    Each round hangs every node on its smallest neighbour, shortens the trees
    that result to their roots, and leaves the links between roots for the next
    round. Every table is written, so a lost executor costs no more than its
    tasks of one step.
    """
    spark = links.sparkSession
    edges = store.written(spark, links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{name}-edges")
    found = None
    while edges.limit(1).count():
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        tree = store.written(spark, both.groupBy("u").agg(F.least("u", F.min("v")).alias("p")), f"{name}-tree")
        while True:
            up = tree.select(F.col("u").alias("p"), F.col("p").alias("r"))
            shorter = store.written(spark, tree.join(up, "p").select("u", F.col("r").alias("p"), (F.col("r") != F.col("p")).alias("moved")), f"{name}-tree")
            store.forget(tree)
            tree = shorter.drop("moved")
            tree._stored = shorter._stored
            if not shorter.where("moved").limit(1).count():
                break
        if found is None:
            found = tree
        else:
            step = tree.select(F.col("u").alias("p"), F.col("p").alias("r"))
            before, found = found, store.written(spark, found.join(step, "p", "left").select("u", F.coalesce("r", "p").alias("p")), f"{name}-found")
            store.forget(before)
        one = tree.select(F.col("u").alias("a"), F.col("p").alias("pa"))
        two = tree.select(F.col("u").alias("b"), F.col("p").alias("pb"))
        left = edges.join(one, "a").join(two, "b").where("pa <> pb")
        before, edges = edges, store.written(spark, left.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), f"{name}-edges")
        store.forget(before, *([tree] if tree is not found else []))
    return found if found is not None else edges.select(F.col("a").alias("u"), F.col("b").alias("p"))
