"""Connected components of a link table, by turns of large and small stars.

Each turn links the neighbours of a node to its smallest neighbour, first the larger
ones, then the smaller ones, until every node hangs on the smallest of its component.
Minima are combined before they are shuffled, and the table stays as narrow as its
links; each turn is written to the checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from feedtriage.scratch import Scratch


def connected_components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b), both long; component is the
    smallest node that can be reached. Links to itself and repeated links are allowed."""
    mark = F.bit_xor(F.xxhash64("a", "b"))
    stars = scratch.save(_directed(links), "links", mark=mark)
    while stars.n_rows:
        turned = scratch.save(_small(_large(stars)), "stars", mark=mark)
        same = (turned.n_rows, turned.metrics["mark"]) == (stars.n_rows, stars.metrics["mark"])
        scratch.drop(stars)
        stars = turned
        if same:
            break
    root = stars.select(F.col("b").alias("node")).distinct()
    return (stars.select(F.col("a").alias("node"), F.col("b").alias("component"))
            .unionByName(root.withColumn("component", F.col("node"))))


def _directed(links: DataFrame) -> DataFrame:
    """From the larger to the smaller node."""
    return (links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
            .distinct())


def _large(stars: DataFrame) -> DataFrame:
    both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return _directed(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")))


def _small(stars: DataFrame) -> DataFrame:
    least = stars.groupBy("a").agg(F.min("b").alias("m"))
    return _directed(stars.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                     .unionByName(least.select("a", F.col("m").alias("b"))))
