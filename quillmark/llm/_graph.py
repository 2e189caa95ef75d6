"""Connected components by alternating stars, for the operators that link documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.common import release, written


def stars(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b); a root is the least node of its component and not listed.

    Large star and small star in turn (Kiveris et al.), each round written to the shared folder. A node's
    neighbours are never gathered: a round takes a minimum a node, which combines map-side, and a join,
    whose hot nodes Spark splits.
    """
    now = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "stars")
    mark = None
    while True:
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        before, now = now, written(small.union(low).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "stars")
        release(before)
        was, mark = mark, now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == was:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
