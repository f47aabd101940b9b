"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, new_path


def components(links: DataFrame) -> DataFrame:
    """node and component (its least reachable node) of every node of links (a, b: long).

    Each round hangs a node's greater neighbours on its least neighbour, then its smaller ones (large and small star);
    both are an aggregation with partial sums and a join whose hot keys adaptive execution splits. A round's links are a
    table in the shared folder; the rounds end when a round changes nothing, after about the logarithm of the longest path.
    """
    spark = links.sparkSession

    def table(df: DataFrame):
        df.write.parquet(path := new_path(spark, "links"))
        out = spark.read.schema("a long, b long").parquet(path)
        mark = out.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        return out, path, tuple(mark)

    # a is the greater end
    edges, path, mark = table(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while mark[0]:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).distinct()
        after, path2, mark2 = table(small)
        drop(spark, path)
        edges, path = after, path2
        if mark2 == mark:
            break
        mark = mark2
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
