"""From claims and pair evidence to the scored graph and the flat record table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notegraph.lineage import Scratch
from notegraph.operators import graph as G
from notegraph.operators import relations as R
from notegraph.operators import scoring as S
from notegraph.operators.records import distinct_claims


@dataclass
class ScoredGraph:
    nodes: DataFrame
    edges: DataFrame
    partitions: DataFrame
    topology: DataFrame
    support: DataFrame
    temporal: DataFrame
    scored: DataFrame
    records: DataFrame


def nodes_of(claims: DataFrame, anchors: DataFrame | None = None) -> DataFrame:
    """One row per claim id of both tables; anchor claims have text alone."""
    rows = distinct_claims(claims)
    if anchors is None:
        return rows
    extra = anchors.where("claim_id is not null").groupBy("claim_id").agg(F.min("text").alias("claim_text")).join(rows, "claim_id", "left_anti")
    return rows.unionByName(extra, allowMissingColumns=True)


def typed_relations(nodes: DataFrame, evidence: DataFrame, relatedness: float = 0.03) -> DataFrame:
    """Valid relations between known claims, gated by their texts."""
    ids = nodes.select("claim_id")
    found = R.relations(evidence, nodes.select("claim_id", F.col("claim_text").alias("text")), relatedness=relatedness)
    return found.join(ids.withColumnRenamed("claim_id", "claim_id_a"), "claim_id_a", "left_semi").join(ids.withColumnRenamed("claim_id", "claim_id_b"), "claim_id_b", "left_semi")


def claim_times(claims: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """claim_id, ts: the earliest claim_ts, where there is none the time of the document.  documents: (document_id, modified_at), one row each."""
    own = claims.where("claim_id is not null").groupBy("claim_id").agg(F.min("claim_ts").alias("ts"), F.min("document_id").alias("document_id"))
    if documents is None:
        return own.select("claim_id", "ts")
    return own.join(documents.select("document_id", "modified_at"), "document_id", "left").select("claim_id", F.coalesce("ts", "modified_at").alias("ts"))


def build(claims: DataFrame, evidence: DataFrame, anchors: DataFrame | None = None, times: DataFrame | None = None, sources: DataFrame | None = None, profile: str = "balanced", run_id: str = "run", relatedness: float = 0.03) -> ScoredGraph:
    """The scored graph.  times: (claim_id, ts); sources: (document_id, source_id, publisher), both optional.

    Pairs with an end that is no known claim are left out of the graph.  Each stage that later ones
    read more than once is written to the shared folder.
    """
    spark = claims.sparkSession
    keep = Scratch(spark, "graph")
    nodes = keep.table(nodes_of(claims, anchors))
    edges = keep.table(G.construct(R.resolve_conflicts(typed_relations(nodes, evidence, relatedness))))
    parts = G.partitions(nodes, edges)
    topo = keep.table(G.roles(G.topology(edges, parts), edges))
    sup = keep.table(G.support(edges, parts))
    temp = keep.table(G.temporal(nodes, edges, claim_times(claims) if times is None else times))
    at = nodes.select(F.col("claim_id").alias("s"), "document_id", "source_path")
    if sources is not None:
        at = at.join(sources.select("document_id", "source_id", "publisher"), "document_id", "left")
    else:
        at = at.withColumns({"source_id": F.lit(None).cast("string"), "publisher": F.lit(None).cast("string")})
    folder = F.regexp_replace("source_path", "/[^/]*$", "")
    by = sup.select("claim_id", F.explode("group_ids").alias("s")).join(at, "s").groupBy("claim_id").agg(
        F.count("*").alias("n_groups"), F.count_distinct(F.coalesce("source_id", "document_id", "s")).alias("n_sources"), F.count_distinct(F.coalesce("publisher", folder)).alias("n_publishers")
    )
    contra = edges.where("relation_type = 'contradicts'").select(F.explode(F.array_distinct(F.array("source", "target"))).alias("claim_id"), "confidence")
    conflict = contra.groupBy("claim_id").agg(F.count("*").alias("contradictions"), F.avg("confidence").alias("contradiction_confidence"))
    wide = (
        sup.join(by, "claim_id", "left").join(conflict, "claim_id", "left").join(topo.select("claim_id", "centrality", "is_hub", "is_bridge"), "claim_id").join(temp.select("claim_id", "temporal_status", "temporal_confidence"), "claim_id")
        .fillna(0, ["n_groups", "n_sources", "n_publishers", "contradictions", "contradiction_confidence"])
    )
    scored = keep.table(S.explain(S.score(S.signals(wide), profile)))
    records = (
        nodes.join(topo.select("claim_id", "partition_id", "semantic_role", "degree", "in_degree", "centrality", "is_hub", "is_bridge"), "claim_id").join(sup.select("claim_id", "support_count", "weighted_confidence", "supporting_ids"), "claim_id")
        .join(temp.select("claim_id", "temporal_status", "temporal_confidence", "time_delta_days"), "claim_id")
        .join(scored.select(
            "claim_id", "reliability_index", "uncertainty_score", "evidence_completeness", "calibration_label", "policy_version", "evidence_strength", "conflict_pressure",
            F.col("summary").alias("explanation_summary"), "dominant_signal", "limiting_signal", F.col("components").alias("component_scores"), "recommendations",
        ), "claim_id").withColumn("audit_run_id", F.lit(run_id))
    )
    return ScoredGraph(nodes, edges, parts, topo, sup, temp, scored, keep.table(records))
