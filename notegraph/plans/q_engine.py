"""Queries of the query engine: predicates, scans, projections, joins by lookup, exports."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notegraph.operators import records
from notegraph.operators import predicates as P
from notegraph.operators import relations as R
from notegraph.plans import sql
from notegraph.plans.base import claim_records, scored_graph, times, typed
from notegraph.plans.registry import query
from notegraph.session import table


def record_query(name: str, sql_text: str | None = None):
    """Registers f(spark, d, records) over the records of the scored graph."""

    def add(f):
        query(name, sql_text)(lambda spark, d: f(spark, d, claim_records(spark, d)))
        return f

    return add


COLS = "claim_id, claim_text, reliability_index, calibration_label"


@record_query("f01_predicates", f"SELECT claim_id, extraction_mode, modality, support_count FROM {sql.RECORDS} WHERE coalesce(support_count >= 1, false) AND modality IS DISTINCT FROM 'certain' AND coalesce(extraction_mode IN ('STRUCTURED', 'PARTIAL'), false)")
def f01(spark, d, rows):
    tests = [P.Predicate("support_count", "gte", 1), P.Predicate("modality", "neq", "certain"), P.Predicate("extraction_mode", "in", ["STRUCTURED", "PARTIAL"])]
    return P.where_all(rows, tests).select("claim_id", "extraction_mode", "modality", "support_count")


@query("f01_null_equals_null", f"SELECT claim_id, context FROM {sql.RECORDS} WHERE context IS NULL")
def f01n(spark, d):
    return P.where_all(claim_records(spark, d), [P.Predicate("context", "eq", None), P.Predicate("claim_text", "neq", 5)]).select("claim_id", "context")


@query("f01_type_mismatch", f"SELECT claim_id, claim_text <> '' AS has_text FROM {sql.RECORDS} WHERE claim_text IS NOT NULL AND degree >= 1")
def f01t(spark, d):
    # a range over text and a number is false, inequality to a number is true
    rows = claim_records(spark, d)
    none = P.where_all(rows, [P.Predicate("claim_text", "gt", 5)])
    kept = P.where_all(rows, [P.Predicate("claim_text", "neq", 5), P.Predicate("claim_text", "neq", None), P.Predicate("degree", "gte", 1)]).unionByName(none)
    return kept.select("claim_id", (F.col("claim_text") != "").alias("has_text"))


@query("f03_text_contains", f"SELECT claim_id, claim_text FROM {sql.CLAIMS} WHERE contains(lower(claim_text), 'protocol') OR contains(lower(claim_text), 'packet')")
def f03(spark, d):
    c = records.distinct_claims(table(spark, d, "claims"))
    return P.where_all(c, [], "Protocol").unionByName(P.where_all(c, [], "PACKET")).distinct().select("claim_id", "claim_text")


@query("f04_point_lookup", f"SELECT claim_id, claim_text, context FROM {sql.CLAIMS} WHERE claim_id = (SELECT min(claim_id) FROM claims)")
def f04(spark, d):
    claims = table(spark, d, "claims")
    first = claims.agg(F.min("claim_id")).first()[0]
    return P.where_all(records.distinct_claims(claims), [P.Predicate("claim_id", "eq", first)]).select("claim_id", "claim_text", "context")


@record_query("f05_search_page", f"SELECT {COLS} FROM {sql.RECORDS} WHERE reliability_index >= 1 AND contains(lower(claim_text), 'the') ORDER BY reliability_index DESC, claim_id LIMIT 50")
def f05(spark, d, rows):
    page, _ = P.scan(rows, [P.Predicate("reliability_index", "gte", 1)], P.Sort("reliability_index", True), P.Page(50), "THE")
    return page.select(*COLS.split(", "))


@record_query("f05_total", f"SELECT count(*) AS total FROM {sql.RECORDS} WHERE support_count >= 1")
def f05t(spark, d, rows):
    return P.scan(rows, [P.Predicate("support_count", "gte", 1)])[1]


@record_query("f07_fetch_reliability", f"SELECT c.claim_id, coalesce(r.reliability_index, 0) AS reliability_index, coalesce(r.uncertainty_score, 100) AS uncertainty_score, coalesce(r.calibration_label, 'very_low') AS calibration_label FROM {sql.CLAIMS} c LEFT JOIN (SELECT * FROM {sql.RECORDS} WHERE support_count >= 1) r USING (claim_id)")
def f07(spark, d, rows):
    rel = rows.where("support_count >= 1").select("claim_id", "reliability_index", "uncertainty_score", "calibration_label")
    return P.claim_view(records.distinct_claims(table(spark, d, "claims")), rel).select("claim_id", "reliability_index", "uncertainty_score", "calibration_label")


@record_query("f08_projection_summary", f"SELECT claim_id, claim_text, context, reliability_index, calibration_label, uncertainty_score FROM {sql.RECORDS}")
def f08s(spark, d, rows):
    return P.project(rows, "summary")


STANDARD = "claim_id, claim_text, reliability_index, calibration_label, uncertainty_score, document_id, source_path, partition_id, semantic_role, degree, centrality, support_count"


@record_query("f08_projection_standard", f"SELECT {STANDARD} FROM {sql.RECORDS}")
def f08(spark, d, rows):
    return P.project(rows, "standard")


@record_query("f08_projection_detailed", f"SELECT {STANDARD}, temporal_status, evidence_strength, conflict_pressure, evidence_completeness FROM {sql.RECORDS}")
def f08d(spark, d, rows):
    return P.project(rows, "detailed")


def _explained(level):
    def run(spark, d):
        from notegraph.plans.requests import KnowledgeService, Search

        # texts and components of the explanation as counts, the rest as it is
        rows = KnowledgeService(scored_graph(spark, d), run_id="audit").execute(Search((P.Predicate("support_count", "gte", 1),), level=level, page=P.Page(1000)))["rows"]
        kept = rows.withColumns({"component_scores": F.size("component_scores"), "has_summary": F.length("explanation_summary") > 0, "n_hints": F.size("recommendations")}).drop("explanation_summary", "recommendations")
        return kept.withColumns({c: F.round(c, 2) for c in ("reliability_index", "uncertainty_score")}).withColumns({c: F.round(c, 3) for c in ("evidence_strength", "conflict_pressure", "evidence_completeness")})

    return run


_PARTS_SQL = [(s, sql.part("balanced", s)) for s in sql.S.family_weights("balanced", sql.S.EVIDENCE)]
_TOP = "[" + ", ".join(f"{{'c': {v}, 's': '{s}'}}" for s, v in _PARTS_SQL) + "]"
EXPLAINED = f"""(SELECT claim_id, coalesce((list_sort(list_transform(list_filter(cs, lambda x: x.c > 0), lambda x: {{'c': -x.c, 's': x.s}})))[1].s, 'none') AS dominant_signal, coalesce((list_sort(list_filter(cs, lambda x: x.c < 0)))[1].s, 'none') AS limiting_signal,
 len(cs) AS component_scores FROM (SELECT claim_id, {_TOP} AS cs FROM {sql.SIGNALS}))"""
query("f08_projection_explainability", None)(_explained("explainability"))
query("f08_projection_full_audit", None)(_explained("full_audit"))


@record_query("k15_dominant", f"SELECT claim_id, dominant_signal, limiting_signal, component_scores AS n_components FROM {EXPLAINED}")
def k15d(spark, d, rows):
    return rows.select("claim_id", "dominant_signal", "limiting_signal", F.size("component_scores").alias("n_components"))


@record_query("f10_rounded", f"SELECT claim_id, round(reliability_index, 2) AS reliability_index, round(weighted_confidence, 3) AS weighted_confidence FROM {sql.RECORDS}")
def f10(spark, d, rows):
    return P.rounded(rows).select("claim_id", "reliability_index", "weighted_confidence")


@record_query("f14_contradictions", f"SELECT claim_id, conflict_pressure, reliability_index FROM {sql.RECORDS} WHERE conflict_pressure > 0 ORDER BY conflict_pressure DESC, claim_id LIMIT 50")
def f14(spark, d, rows):
    return P.scan(rows, [P.Predicate("conflict_pressure", "gt", 0)], P.Sort("conflict_pressure", True), P.Page(50))[0].select("claim_id", "conflict_pressure", "reliability_index")


@record_query("f14_provenance", f"SELECT claim_id, source_path, support_count FROM {sql.RECORDS} ORDER BY support_count DESC, claim_id LIMIT 25")
def f14p(spark, d, rows):
    return P.scan(rows, [], P.Sort("support_count", True), P.Page(25))[0].select("claim_id", "source_path", "support_count")


@record_query("o01_sort_null_as_zero", f"SELECT claim_id, weighted_confidence FROM {sql.RECORDS} ORDER BY coalesce(weighted_confidence, 0) DESC, claim_id LIMIT 100")
def o01(spark, d, rows):
    return P.scan(rows, [], P.Sort("weighted_confidence", True), P.Page(100))[0].select("claim_id", "weighted_confidence")


@record_query("o02_offset_page", f"SELECT claim_id, degree FROM {sql.RECORDS} ORDER BY degree, claim_id LIMIT 40 OFFSET 80")
def o02(spark, d, rows):
    return P.scan(rows, [], P.Sort("degree"), P.Page(40, 80))[0].select("claim_id", "degree")


@record_query("o03_least_reliable", f"SELECT claim_id, reliability_index FROM {sql.RECORDS} ORDER BY reliability_index, claim_id LIMIT 20")
def o03(spark, d, rows):
    return rows.orderBy("reliability_index", "claim_id").limit(20).select("claim_id", "reliability_index")


@query("o04_pair_limit", "SELECT claim_id_a, claim_id_b, cosine_similarity FROM (SELECT DISTINCT claim_id_a, claim_id_b, cosine_similarity FROM candidate_pairs) ORDER BY cosine_similarity DESC NULLS LAST, claim_id_a, claim_id_b NULLS LAST LIMIT 500")
def o04(spark, d):
    pairs = table(spark, d, "candidate_pairs").select("claim_id_a", "claim_id_b", "cosine_similarity").distinct()
    return pairs.orderBy(F.desc_nulls_last("cosine_similarity"), "claim_id_a", F.asc_nulls_last("claim_id_b")).limit(500)


@query("j03_pair_texts", f"SELECT e.claim_id_a, e.claim_id_b, a.claim_text AS text_a, b.claim_text AS text_b FROM {sql.FLAT} e JOIN {sql.CLAIMS} a ON a.claim_id = e.claim_id_a JOIN {sql.CLAIMS} b ON b.claim_id = e.claim_id_b")
def j03(spark, d):
    c = records.distinct_claims(table(spark, d, "claims")).select("claim_id", "claim_text")
    e = R.flat_evidence(table(spark, d, "relationship_evidence"))
    a, b = (c.select(F.col("claim_id").alias(f"claim_id_{x}"), F.col("claim_text").alias(f"text_{x}")) for x in "ab")
    return e.join(a, "claim_id_a").join(b, "claim_id_b").select("claim_id_a", "claim_id_b", "text_a", "text_b")


@query("j04_dangling_ends", f"SELECT DISTINCT x AS claim_id FROM (SELECT claim_id_a AS x FROM {sql.FLAT} UNION ALL SELECT claim_id_b FROM {sql.FLAT}) WHERE x NOT IN (SELECT claim_id FROM claims)")
def j04(spark, d):
    e = table(spark, d, "relationship_evidence")
    ends = e.select(F.explode(F.array("claim_id_a", "claim_id_b")).alias("claim_id")).distinct()
    return ends.join(table(spark, d, "claims"), "claim_id", "left_anti")


@query("j07_claim_timestamps", "SELECT c.claim_id, coalesce(c.ts, d.modified_at) AS ts FROM (SELECT claim_id, min(claim_ts) AS ts, min(document_id) AS document_id FROM claims GROUP BY 1) c LEFT JOIN documents d ON d.doc_key = c.document_id")
def j07(spark, d):
    return times(spark, d)


@query("j11_delta", "SELECT DISTINCT claim_id FROM embedded_claims WHERE claim_id NOT IN (SELECT claim_id_a FROM candidate_pairs WHERE claim_id_a IS NOT NULL) AND claim_id NOT IN (SELECT claim_id_b FROM candidate_pairs WHERE claim_id_b IS NOT NULL)")
def j11(spark, d):
    from notegraph.streaming.incremental import delta

    pairs = table(spark, d, "candidate_pairs")
    known = pairs.select(F.explode(F.array("claim_id_a", "claim_id_b")).alias("claim_id")).where("claim_id is not null")
    return delta(table(spark, d, "embedded_claims").select("claim_id").distinct(), known)


@query("j12_invalidate", f"SELECT relationship_id FROM {sql.FLAT} WHERE claim_id_a NOT IN (SELECT claim_id FROM anchor_claims) AND claim_id_b NOT IN (SELECT claim_id FROM anchor_claims)")
def j12(spark, d):
    from notegraph.streaming.incremental import invalidate

    return invalidate(R.flat_evidence(table(spark, d, "relationship_evidence")), table(spark, d, "anchor_claims")).select("relationship_id")


@record_query("s16_export_csv", f"SELECT claim_id || ',' || calibration_label || ',' || cast(support_count AS VARCHAR) AS line FROM {sql.RECORDS} WHERE support_count >= 1")
def s16(spark, d, rows):
    from notegraph.sources.sinks import csv_lines

    return csv_lines(P.where_all(rows, [P.Predicate("support_count", "gte", 1)]), "claim_id", "calibration_label", "support_count")


@query("s17_export_graphml", f"""SELECT '<node id="' || claim_id || '"><data key="label">' || left(replace(replace(replace(claim_text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), 80) || '</data></node>' AS line FROM {sql.CLAIMS} UNION ALL
 SELECT '<edge id="' || edge_id || '" source="' || claim_id_a || '" target="' || claim_id_b || '"/>' FROM {sql.EDGES}""")
def s17(spark, d):
    from notegraph.sources.sinks import graphml_lines

    return graphml_lines(records.distinct_claims(table(spark, d, "claims")), typed(spark, d))


@query("u01_node_union", f"SELECT claim_id_a AS claim_id FROM {sql.EDGES} UNION SELECT claim_id_b FROM {sql.EDGES}")
def u01(spark, d):
    e = typed(spark, d)
    return e.select(F.explode(F.array("claim_id_a", "claim_id_b")).alias("claim_id")).distinct()


@query("u02_key_difference", "SELECT claim_id FROM (SELECT claim_id FROM claims EXCEPT SELECT claim_id_a FROM candidate_pairs EXCEPT SELECT claim_id_b FROM candidate_pairs)")
def u02(spark, d):
    pairs = table(spark, d, "candidate_pairs")
    used = [pairs.select(F.col(f"claim_id_{x}").alias("claim_id")) for x in "ab"]
    return table(spark, d, "claims").select("claim_id").subtract(used[0]).subtract(used[1])


@query("u02_key_intersection", "SELECT claim_id_a AS claim_id FROM candidate_pairs INTERSECT SELECT claim_id_b FROM candidate_pairs INTERSECT SELECT claim_id FROM claims")
def u02i(spark, d):
    pairs = table(spark, d, "candidate_pairs")
    used = [pairs.select(F.col(f"claim_id_{x}").alias("claim_id")) for x in "ab"]
    return used[0].intersect(used[1]).intersect(table(spark, d, "claims").select("claim_id"))


@query("u04_unordered_pairs", """SELECT x AS claim_id_a, y AS claim_id_b, cosine_similarity, candidate_rank FROM (SELECT least(claim_id_a, claim_id_b) AS x, greatest(claim_id_a, claim_id_b) AS y, cosine_similarity, candidate_rank,
 row_number() OVER (PARTITION BY least(claim_id_a, claim_id_b), greatest(claim_id_a, claim_id_b) ORDER BY run_id, candidate_rank, cosine_similarity DESC NULLS LAST) AS o FROM candidate_pairs WHERE claim_id_a IS NOT NULL AND claim_id_b IS NOT NULL AND claim_id_a <> claim_id_b) WHERE o = 1""")
def u04(spark, d):
    from notegraph.operators.similarity import unordered_pairs

    return unordered_pairs(table(spark, d, "candidate_pairs"))


@record_query("f13_filter_form", f"SELECT claim_id FROM {sql.RECORDS} WHERE reliability_index >= 25 AND coalesce(semantic_role = 'leaf_claim', false)")
def f13(spark, d, rows):
    from notegraph.plans.requests import filter_predicates

    return P.where_all(rows, list(filter_predicates({"reliability_index": 25, "semantic_role": "leaf_claim", "context": "", "document_id": None}))).select("claim_id")


@record_query("f16_claim_cards", f"SELECT claim_id, left(claim_id, 8) AS short_id, list_aggregate(list_transform(string_split(calibration_label, '_'), lambda w: upper(w[1]) || w[2:]), 'string_agg', ' ') AS label_display, list_aggregate(list_transform(string_split(semantic_role, '_'), lambda w: upper(w[1]) || w[2:]), 'string_agg', ' ') AS role_display FROM {sql.RECORDS}")
def f16(spark, d, rows):
    from notegraph.operators.presentation import claim_cards

    return claim_cards(rows).select("claim_id", "short_id", "label_display", "role_display")


@record_query("index_entries", f"SELECT field, value, count(*) AS n FROM (SELECT claim_id, unnest([{{'field': 'calibration_label', 'value': calibration_label}}, {{'field': 'semantic_role', 'value': semantic_role}}, {{'field': 'document_id', 'value': document_id}}, {{'field': 'partition_id', 'value': partition_id}}, {{'field': 'reliability_index_bucket', 'value': CAST((floor(reliability_index / 10) * 10)::INTEGER AS VARCHAR)}}], recursive := true) FROM {sql.RECORDS}) WHERE value IS NOT NULL GROUP BY 1, 2")
def indexed(spark, d, rows):
    from notegraph.plans.requests import index_entries

    return index_entries(rows).groupBy("field", "value").agg(F.count("*").alias("n"))
