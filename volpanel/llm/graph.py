"""Connected components of an edge table, without bringing links or nodes to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from volpanel.session import durable


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b); root is the smallest node of the component.

    Alternates the large star (a node's larger neighbours move to its smallest one) and the small star (its smaller
    ones do) until every node hangs on its root. Each round is checkpointed. A node with very many neighbours is
    reduced by a map-side minimum, and the join back to its edges is a merge join, which Spark splits when it is skewed;
    rounds without broadcasts keep the driver's memory flat.
    """
    links = durable(edges.where("a <> b").selectExpr("greatest(a, b) AS a", "least(a, b) AS b").distinct())
    before = None
    while True:
        both = links.union(links.selectExpr("b AS a", "a AS b"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).selectExpr("a", "least(a, m) AS m")
        large = both.join(least.hint("merge"), "a").where("b > a").selectExpr("b AS a", "m AS b")
        large = large.where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least.hint("merge"), "a")
        small = joined.selectExpr("b AS a", "m AS b").union(least.selectExpr("a", "m AS b"))
        links = durable(small.where("a <> b").distinct())
        after = links.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).head()
        if after == before:
            break
        before = after
    roots = links.select(F.col("b").alias("node")).distinct().selectExpr("node", "node AS root")
    return links.selectExpr("a AS node", "b AS root").union(roots)
