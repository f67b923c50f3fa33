"""Connected components of a graph of nodes and groups, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import Stored

#: Keys that the rows of one key are dealt to, by hashes of another column.
PARTS = 16


def looked_up(rows: DataFrame, key: str, by: str, table: DataFrame) -> DataFrame:
    """The rows with the columns of a table that has one row for each key; null where it has none.

    Rows of a key are dealt to PARTS keys by the hash of ``by``, so a key that many rows share isn't hot.
    """
    dealt = rows.withColumn("part", F.pmod(F.xxhash64(by), F.lit(PARTS)).cast("int"))
    wanted = dealt.select(key, "part").distinct().join(table, key)
    return dealt.join(wanted, [key, "part"], "left").drop("part")


def components(members: DataFrame) -> Stored:
    """(node, label) from (node, group): nodes of one group are connected; label is the least node.

    A round gives each node the least node of its groups as its parent; parents are followed to the
    roots, each step doubling the way.  Then nodes are replaced by their roots; repeated rows
    vanish, and so do groups that one node is left of.  A component of several nodes keeps at most
    every second of them, so the rows of all rounds are at most twice those of the first.
    Rounds are written to the shared folder, so lineage stays short.
    """
    first = edges = Stored(members.select("node", "group").distinct(), "cc-edges", F.lit(True))
    rounds: list[Stored] = []
    while first.found:
        least = edges.frame.groupBy("group").agg(F.min("node").alias("least"), F.count(F.lit(1)).alias("rows")).filter("rows > 1").drop("rows")
        parents = looked_up(edges.frame, "group", "node", least).groupBy("node").agg(F.min("least").alias("root")).filter("root is not null")
        rounds.append(_followed(Stored(parents, "cc-roots")))
        moved = edges.frame.join(rounds[-1].frame, "node").select(F.col("root").alias("node"), "group")
        several = moved.groupBy("group").agg((F.min("node") < F.max("node")).alias("several")).filter("several")
        if not several.limit(1).count():
            break
        farther = Stored(moved.distinct(), "cc-edges")
        if edges is not first:
            edges.discard()
        edges = farther
    labels = first.frame.select("node", F.col("node").alias("label")).distinct()
    for one in rounds:
        labels = looked_up(labels, "label", "node", one.frame.withColumnRenamed("node", "label")).select("node", F.coalesce("root", "label").alias("label"))
    found = Stored(labels, "cc-labels")
    for done in {first, edges, *rounds}:
        done.discard()
    return found


def _followed(parents: Stored) -> Stored:
    """(node, root) with the root of each node in place of its parent."""
    while True:
        above = parents.frame.select(F.col("node").alias("root"), F.col("root").alias("next"))
        farther = Stored(looked_up(parents.frame, "root", "node", above).select("node", "root", "next"), "cc-roots", F.col("next") < F.col("root"))
        parents.discard()
        parents, parents.frame = farther, farther.frame.select("node", F.col("next").alias("root"))
        if not parents.found:
            return parents
