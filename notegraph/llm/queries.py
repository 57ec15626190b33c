"""The pN_ queries over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notegraph.llm import components, consensus, mixing, neighbors, overlaps, packing, residue, sentences, splits
from notegraph.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _passes(spark: SparkSession, d: str) -> list[DataFrame]:
    return [table(spark, d, f"pass{i}_relationships") for i in (1, 2)]


@_query
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return overlaps.found(table(spark, d, "v1_pilot_manifest"))


@_query
def p1_report(spark: SparkSession, d: str) -> DataFrame:
    return overlaps.report(table(spark, d, "v1_pilot_manifest"))


@_query
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbors.similar_pairs(table(spark, d, "embedded_claims"))


@_query
def p2_neighbors(spark: SparkSession, d: str) -> DataFrame:
    return neighbors.neighbors(table(spark, d, "embedded_claims"))


@_query
def p2_recall(spark: SparkSession, d: str) -> DataFrame:
    return neighbors.recall_report(table(spark, d, "embedded_claims"))


@_query
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return consensus.consensus(*_passes(spark, d))[0].select("id", "label", "direction")


@_query
def p3_reliability(spark: SparkSession, d: str) -> DataFrame:
    return consensus.reliability(*_passes(spark, d))


@_query
def p3_agreement(spark: SparkSession, d: str) -> DataFrame:
    return consensus.agreement(*_passes(spark, d))


@_query
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.split_sentences(table(spark, d, "scanner_events"), table(spark, d, "claims")).select("event_id", "sent_start", "sent_end")


@_query
def p4_sentences(spark: SparkSession, d: str) -> DataFrame:
    return sentences.document_sentences(table(spark, d, "scanner_events"), table(spark, d, "claims"))


@_query
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return splits.divided_groups(table(spark, d, "v1_pilot_manifest"))


@_query
def p5_splits(spark: SparkSession, d: str) -> DataFrame:
    return splits.assign_splits(table(spark, d, "v1_pilot_manifest"), table(spark, d, "split_targets"))


@_query
def p5_balance(spark: SparkSession, d: str) -> DataFrame:
    records, targets = table(spark, d, "v1_pilot_manifest"), table(spark, d, "split_targets")
    return splits.split_report(splits.assign_splits(records, targets), records, targets)


@_query
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return components.claim_groups(table(spark, d, "candidate_pairs")).where(F.col("claim_id") != F.col("group_id"))


@_query
def p6_groups(spark: SparkSession, d: str) -> DataFrame:
    return components.claim_groups(table(spark, d, "candidate_pairs"))


@_query
def p7_pack(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents"), table(spark, d, "pack_capacities"))


@_query
def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return packing.report(packing.pack(table(spark, d, "documents"), table(spark, d, "pack_capacities")))


@_query
def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))


@_query
def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    documents, targets = table(spark, d, "documents"), table(spark, d, "mix_targets")
    return mixing.shares(mixing.mix(documents, targets), targets, documents)


@_query
def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.residue(table(spark, d, "documents"))


@_query
def p9_findings(spark: SparkSession, d: str) -> DataFrame:
    return residue.findings(table(spark, d, "documents"))


@_query
def p9_clean(spark: SparkSession, d: str) -> DataFrame:
    return residue.clean(table(spark, d, "documents")).select("doc_id", "doc_key", "n_chars")


_KNOWN = ", ".join("'" + x + "'" for x in splits.NOT_KNOWN)
_KEYS = " UNION ALL ".join(f"SELECT row_id, '{i}:' || v AS k FROM (SELECT row_id, lower(trim({c})) AS v FROM v1_pilot_manifest) WHERE v IS NOT NULL AND v NOT IN ({_KNOWN})" for i, c in enumerate(splits.KEYS))
_LINKS = "SELECT DISTINCT claim_id_a AS a, claim_id_b AS b FROM candidate_pairs WHERE below_threshold = false AND claim_id_a <> claim_id_b"
_GROUPS = f"WITH RECURSIVE e AS (SELECT a AS x, b AS y FROM ({_LINKS}) UNION SELECT b, a FROM ({_LINKS})), r(x, y) AS (SELECT DISTINCT x, x FROM e UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y), g AS (SELECT min(y) AS group_id, x AS claim_id FROM r GROUP BY x)"
_VOTES = """(SELECT id, annotator_id, label FROM (SELECT id, annotator_id, upper(trim(label)) AS label, row_number() OVER (PARTITION BY id, annotator_id ORDER BY annotated_at DESC NULLS LAST, upper(trim(label)) DESC NULLS LAST) AS o
 FROM (SELECT * FROM pass1_relationships UNION ALL SELECT * FROM pass2_relationships) WHERE id IS NOT NULL AND annotator_id IS NOT NULL) WHERE o = 1 AND label IN ('NEUTRAL', 'SUPPORTS', 'REFINES', 'CONTRADICTS', 'EQUIVALENT'))"""

ORACLE_SQL |= {
    "p2_found": """WITH u AS (SELECT claim_id, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) AS v FROM (SELECT claim_id, vector::DOUBLE[] AS v FROM (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY embedded_at DESC NULLS LAST) AS o FROM embedded_claims)
  WHERE o = 1 AND len(vector) = 96 AND len(list_filter(vector, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(vector, lambda x: x <> 0)) > 0)),
 s AS (SELECT a.claim_id AS a, b.claim_id AS b, list_inner_product(a.v, b.v) AS c FROM u a JOIN u b ON a.claim_id <> b.claim_id), t AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(c, 6) DESC, b) AS o FROM s)
 SELECT DISTINCT least(a, b) AS claim_id_a, greatest(a, b) AS claim_id_b FROM t WHERE o <= 10 AND c >= 0.75""",
    "p3_agreement": f"""WITH n AS (SELECT id, label, count(*) AS n FROM {_VOTES} GROUP BY 1, 2), m AS (SELECT id, sum(n) AS m FROM n GROUP BY 1 HAVING sum(n) > 1), c AS (SELECT * FROM n JOIN m USING (id)),
 s AS (SELECT count(DISTINCT id) AS n_ids, sum(n)::BIGINT AS total, sum(n * (n - 1)::DOUBLE / (m - 1)) AS same FROM c), p AS (SELECT sum(n * (n - 1)) AS pairs FROM (SELECT label, sum(n)::DOUBLE AS n FROM c GROUP BY 1))
 SELECT n_ids, total AS n_votes, round(1 - same / total, 6) AS observed_disagreement, round(1 - pairs / (total::DOUBLE * (total - 1)), 6) AS expected_disagreement, round(1 - (1 - same / total) / (1 - pairs / (total::DOUBLE * (total - 1))), 6) AS alpha FROM s, p""",
    "p5_found": f"""WITH RECURSIVE k AS ({_KEYS}), h AS (SELECT k, min(row_id) AS y FROM k GROUP BY 1), e AS (SELECT row_id AS x, y FROM k JOIN h USING (k) UNION SELECT y, row_id FROM k JOIN h USING (k)),
 r(x, y) AS (SELECT row_id, row_id FROM v1_pilot_manifest UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y), g AS (SELECT min(y) AS group_id, x AS row_id FROM r GROUP BY x), d AS (SELECT group_id FROM g JOIN v1_pilot_manifest USING (row_id) WHERE trim(split) <> '' GROUP BY 1 HAVING count(DISTINCT lower(trim(split))) > 1)
 SELECT group_id, row_id FROM g WHERE group_id IN (SELECT group_id FROM d)""",
    "p6_found": f"{_GROUPS} SELECT group_id, claim_id FROM g WHERE group_id <> claim_id",
    "p6_groups": f"{_GROUPS} SELECT group_id, claim_id FROM g",
}
