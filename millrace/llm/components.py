"""Connected components of links by contraction, on tables throughout.

Each round every node points to the neighbour with the least scrambled id and the links move on
to where their ends point; links within a group vanish. Scrambling makes the number of links fall
by a constant share each round whatever the order of ids. Rounds meet through tables in the
shared folder; links and components stay in them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import scramble, table_cut


def components(links: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``a, b`` (long, not null); the component is the smallest node reachable.

    Links may repeat, come in either direction and join a node to itself. An empty table gives no rows.
    """
    edges = links.select(scramble(F.col("a")).alias("a"), scramble(F.col("b")).alias("b")).where("a <> b")
    edges = table_cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    nodes = table_cut(links.select(F.explode(F.array("a", "b")).alias("node")).distinct().select("node", scramble(F.col("node")).alias("at")), "nodes")
    while not edges.isEmpty():
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        point = both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("from"), F.least("a", "low").alias("to"))
        point = table_cut(point, "pointers")
        # Follow pointers twice: they only ever go down, so this ends nearer to the root.
        hop = point.select(F.col("from").alias("h_from"), F.col("to").alias("h_to"))
        point = table_cut(point.join(hop, F.col("to") == F.col("h_from"), "left").select("from", F.coalesce("h_to", "to").alias("to")), "pointers")
        end_a, end_b = (point.select(F.col("from").alias(f"{x}_from"), F.col("to").alias(f"{x}_to")) for x in "ab")
        moved = edges.join(end_a, F.col("a") == F.col("a_from")).join(end_b, F.col("b") == F.col("b_from"))
        moved = moved.where("a_to <> b_to").select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b"))
        edges = table_cut(moved.distinct(), "edges")
        nodes = table_cut(nodes.join(end_a, F.col("at") == F.col("a_from"), "left").select("node", F.coalesce("a_to", "at").alias("at")), "nodes")
    least = nodes.groupBy("at").agg(F.min("node").alias("component")).select(F.col("at").alias("c_at"), "component")
    return nodes.join(least, F.col("at") == F.col("c_at")).select("node", "component")
