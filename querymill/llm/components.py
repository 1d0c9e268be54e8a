"""Connected components by Hash-to-Min, on rows (node, member)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querymill.session import cut


def components(edges: DataFrame, left: str = "a", right: str = "b", most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of the undirected edges; component is its smallest node.

    Hash-to-Min: every node holds a cluster, at first itself and its neighbours. In a round it sends
    the cluster to the cluster's smallest node, and that node to all the others, and unites what it
    gets; the rounds, about logarithmic in the diameter, end when nothing changes. A cluster is rows,
    never an array: a node that a third of all edges meet is aggregated before the shuffle and its
    join is split by the adaptive skew join. Each round is kept in the shared folder.

    Null ends and repeated edges are ignored; a loop makes its node a component. No edges, no rows.
    """
    e = edges.select(F.col(left).alias("v"), F.col(right).alias("u")).where("v is not null and u is not null")
    clusters = cut(e.union(e.select("u", "v")).union(e.select("v", "v")).union(e.select("u", "u")).distinct())
    before = None
    for _ in range(most_rounds):
        least = clusters.groupBy("v").agg(F.min("u").alias("m"))
        sent = clusters.join(least, "v").select(F.explode(F.array(F.struct(F.col("m").alias("v"), F.col("u").alias("u")), F.struct(F.col("u").alias("v"), F.col("m").alias("u")))).alias("x")).select("x.v", "x.u")
        clusters = cut(sent.distinct())
        # the sum over nodes of (minimum, cluster size) says whether a round has changed anything
        now = clusters.agg(F.count(F.lit(1)), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if now == before:
            return clusters.groupBy("v").agg(F.min("u").alias("component")).withColumnRenamed("v", "node")
        before = now
    raise RuntimeError(f"the components are not stable after {most_rounds} rounds")
