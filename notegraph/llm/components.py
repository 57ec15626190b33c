"""Problem 6: pairwise matches consolidated into groups by deterministic Boruvka hooking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notegraph.lineage import Scratch
from notegraph.operators.joins import split_hot


def _collapse(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """One hooking step: (c, p) with p the root of the tree that c was hooked into.

    With edges ordered by (smaller label, larger label), the smallest outgoing edge of a
    component always leads to its smallest neighbour, so the chosen edges are one partial
    aggregate and the only cycles are mutual pairs, whose smaller label becomes the root.
    """
    both = edges.select(F.col("u").alias("c"), F.col("v").alias("n")).unionByName(
        edges.select(F.col("v").alias("c"), F.col("u").alias("n"))
    )
    hooked = scratch.table(both.groupBy("c").agg(F.min("n").alias("p")))
    of = hooked.select(F.col("c").alias("p"), F.col("p").alias("g"))
    rooted = split_hot(hooked, of, "p").select(
        "c",
        F.when((F.col("g") == F.col("c")) & (F.col("c") < F.col("p")), F.col("c")).otherwise(F.col("p")).alias("p"),
    )
    current = scratch.table(rooted.withColumn("moved", F.lit(True)))
    scratch.drop(hooked)
    while True:
        of = current.select(F.col("c").alias("p"), F.col("p").alias("g"))
        jumped = scratch.table(
            split_hot(current, of, "p").select("c", F.col("g").alias("p"), (F.col("g") != F.col("p")).alias("moved"))
        )
        scratch.drop(current)
        current = jumped
        if current.where("moved").isEmpty():
            return current.select("c", "p")


def consolidate(links: DataFrame, a: str, b: str, group: str = "group_id", member: str = "member_id") -> DataFrame:
    """(group, member) for every id in `links`, group being the smallest id reachable from it.

    Links with a null end and links of an id with itself are ignored; reversed and repeated
    links count once; an empty input gives an empty result.  Extra columns are not read.
    Each round at least halves the number of live components; labels, edges and maps stay
    in distributed tables that are written to the shared folder.
    """
    spark = links.sparkSession
    scratch = Scratch(spark, "components")
    ends = links.select(links[a].alias("x"), links[b].alias("y"))
    edges = scratch.table(
        ends.where("x is not null and y is not null and x != y")
        .select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v"))
        .distinct()
    )
    members: DataFrame | None = None
    while not edges.isEmpty():
        step = _collapse(scratch, edges)
        left = step.select(F.col("c").alias("u"), F.col("p").alias("ru"))
        right = step.select(F.col("c").alias("v"), F.col("p").alias("rv"))
        fewer = scratch.table(
            split_hot(edges, left, "u")
            .join(right, "v")
            .where("ru != rv")
            .select(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v"))
            .distinct()
        )
        scratch.drop(edges)
        edges = fewer
        if members is None:
            members = step.select(F.col("c").alias("m"), F.col("p").alias("r"))
        else:
            on = step.select(F.col("c").alias("r"), F.col("p").alias("next"))
            members = members.join(on, "r", "left").select("m", F.coalesce("next", "r").alias("r"))
    if members is None:
        members = edges.select(F.col("u").alias("m"), F.col("v").alias("r"))
    members = scratch.table(members)
    smallest = members.groupBy("r").agg(F.min("m").alias("g"))
    return split_hot(members, smallest, "r").select(F.col("g").alias(group), F.col("m").alias(member))


def claim_groups(candidate_pairs: DataFrame) -> DataFrame:
    """group_id, claim_id of every claim of an accepted pair, the smallest claim included.

    Accepted means below_threshold = false; a null flag is not accepted.
    """
    accepted = candidate_pairs.where(F.col("below_threshold") == F.lit(False))
    return consolidate(accepted, "claim_id_a", "claim_id_b", "group_id", "claim_id")
