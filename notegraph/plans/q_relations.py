"""Queries of relation classification."""

from pyspark.sql import functions as F

from notegraph.functions import lexicon
from notegraph.functions import vectors as V
from notegraph.operators import records
from notegraph.operators import relations as R
from notegraph.plans import sql
from notegraph.plans.base import flat, nodes_of, typed
from notegraph.plans.registry import query
from notegraph.session import table


def gated(spark, d):
    """Every evidence row with its type after the gates."""
    return R.apply_gates(R.resolve(flat(spark, d)), nodes_of(spark, d).select("claim_id", F.col("claim_text").alias("text")))


@query("r02_predicted_label", f"""SELECT relationship_id, CASE WHEN c_ab = greatest(e_ab, n_ab, c_ab) THEN 'contradiction' WHEN e_ab = greatest(e_ab, n_ab, c_ab) THEN 'entailment' WHEN n_ab = greatest(e_ab, n_ab, c_ab) THEN 'neutral' END AS predicted,
 greatest(e_ab, n_ab, c_ab) AS raw_confidence FROM {sql.FLAT}""")
def r02(spark, d):
    x = [F.col(c) for c in ("e_ab", "n_ab", "c_ab")]
    return flat(spark, d).select("relationship_id", R.predicted_label(*x).alias("predicted"), R.raw_confidence(*x).alias("raw_confidence"))


@query("r03_temperature", f"""SELECT relationship_id, round(greatest(pe, pn, pc) / (pe + pn + pc), 6) AS calibrated FROM (SELECT relationship_id, exp(ln(greatest(e_ab, 1e-12)) / 3.33) AS pe, exp(ln(greatest(n_ab, 1e-12)) / 3.33) AS pn, exp(ln(greatest(c_ab, 1e-12)) / 3.33) AS pc FROM {sql.FLAT})""")
def r03(spark, d):
    return flat(spark, d).select("relationship_id", F.round(R.temperature_confidence(F.col("e_ab"), F.col("n_ab"), F.col("c_ab"), 3.33), 6).alias("calibrated"))


@query("r03_percentile", f"SELECT relationship_id, len(list_filter([0.3, 0.5, 0.6, 0.7, 0.8, 0.9]::DOUBLE[], lambda x: x < greatest(e_ab, n_ab, c_ab))) / 6.0::DOUBLE AS calibrated FROM {sql.FLAT}")
def r03p(spark, d):
    raw = R.raw_confidence(F.col("e_ab"), F.col("n_ab"), F.col("c_ab"))
    return flat(spark, d).select("relationship_id", R.percentile_confidence(raw, [0.3, 0.5, 0.6, 0.7, 0.8, 0.9]).alias("calibrated"))


@query("r03_isotonic", f"SELECT relationship_id, round(CASE WHEN x <= 0.4 THEN 0.35 WHEN x <= 0.7 THEN 0.35 + (x - 0.4) * ((0.6 - 0.35) / (0.7 - 0.4)) WHEN x <= 1.0 THEN 0.6 + (x - 0.7) * ((0.95 - 0.6) / (1.0 - 0.7)) ELSE 0.95 END::DOUBLE, 6) AS calibrated FROM (SELECT relationship_id, greatest(e_ab, n_ab, c_ab) AS x FROM {sql.FLAT})")
def r03i(spark, d):
    raw = R.raw_confidence(F.col("e_ab"), F.col("n_ab"), F.col("c_ab"))
    return flat(spark, d).select("relationship_id", F.round(R.isotonic_confidence(raw, [(0.4, 0.35), (0.7, 0.6), (1.0, 0.95)]), 6).alias("calibrated"))


@query("r04_resolved", f"SELECT relationship_id, relation_type, direction FROM {sql.RESOLVED}")
def r04(spark, d):
    return R.resolve(flat(spark, d)).select("relationship_id", "relation_type", "direction")


@query("r04_priority_neutral_first", f"SELECT relationship_id, CASE WHEN coalesce(greatest(n, n_ab, n_ba) >= 0.6, false) THEN 'neutral' ELSE relation_type END AS relation_type FROM {sql.RESOLVED}")
def r04n(spark, d):
    policy = R.ResolverPolicy(priority=("neutral", "contradicts", "equivalent", "supports", "refines", "unknown"))
    return R.resolve(flat(spark, d), policy).select("relationship_id", "relation_type")


@query("r06_decision_confidence", f"SELECT relationship_id, round(decision_confidence, 9) AS decision_confidence FROM {sql.DECIDED}")
def r06(spark, d):
    return gated(spark, d).select("relationship_id", F.round(R.decision_confidence(), 9).alias("decision_confidence"))


@query("r07_decision_status", f"SELECT relationship_id, CASE WHEN relation_type = 'unknown' THEN 'abstained' ELSE 'resolved' END AS status, CASE WHEN relation_type <> 'unknown' THEN relation_type END AS relation_type FROM {sql.RESOLVED}")
def r07(spark, d):
    t = F.col("relation_type")
    return R.resolve(flat(spark, d)).select("relationship_id", F.when(t == "unknown", "abstained").otherwise("resolved").alias("status"), F.when(t != "unknown", t).alias("relation_type"))


NEG = sql._list(lexicon.NEGATION_CUES)
content, caps = sql.content, sql.caps


PAIRS = f"(SELECT e.relationship_id, a.claim_text AS ta, b.claim_text AS tb, e.cosine_similarity FROM {sql.FLAT} e JOIN {sql.CLAIMS} a ON a.claim_id = e.claim_id_a JOIN {sql.CLAIMS} b ON b.claim_id = e.claim_id_b)"


def pair_texts(spark, d):
    c = records.distinct_claims(table(spark, d, "claims"))
    a = c.select(F.col("claim_id").alias("claim_id_a"), F.col("claim_text").alias("ta"))
    b = c.select(F.col("claim_id").alias("claim_id_b"), F.col("claim_text").alias("tb"))
    return flat(spark, d).join(a, "claim_id_a").join(b, "claim_id_b")


@query("r08_relatedness", f"""SELECT relationship_id, round(CASE WHEN shared > 0 THEN greatest(j, 0.5) ELSE j END, 9) AS relatedness FROM (SELECT relationship_id, len(list_intersect(ca, cb)) AS shared,
 CASE WHEN len(x) = 0 OR len(y) = 0 THEN 0.0 ELSE len(list_intersect(x, y))::DOUBLE / (len(x) + len(y) - len(list_intersect(x, y))) END AS j
 FROM (SELECT relationship_id, {content('ta')} AS x, {content('tb')} AS y, {caps('ta')} AS ca, {caps('tb')} AS cb FROM {PAIRS}))""")
def r08(spark, d):
    return pair_texts(spark, d).select("relationship_id", F.round(lexicon.relatedness(F.col("ta"), F.col("tb")), 9).alias("relatedness"))


@query("r09_specificity", f"SELECT claim_id, {sql.specificity('t')} AS specificity FROM (SELECT claim_id, coalesce(claim_text, '') AS t FROM {sql.CLAIMS})")
def r09(spark, d):
    c = records.distinct_claims(table(spark, d, "claims"))
    return c.select("claim_id", lexicon.specificity(F.col("claim_text")).alias("specificity"))


@query("r08_gated_types", f"SELECT relationship_id, relation_type FROM {sql.GATED}")
def r08g(spark, d):
    return gated(spark, d).select("relationship_id", "relation_type")


@query("r10_rejections", f"SELECT rejection_reason, count(*) AS n FROM {sql.DECIDED} GROUP BY 1")
def r10(spark, d):
    out = gated(spark, d).withColumn("decision_confidence", R.decision_confidence())
    return out.groupBy(R.rejection_reason().alias("rejection_reason")).agg(F.count("*").alias("n"))


@query("r11_relations", f"SELECT edge_id, claim_id_a, claim_id_b, relation_type, direction FROM {sql.EDGES}")
def r11(spark, d):
    return typed(spark, d).select("edge_id", "claim_id_a", "claim_id_b", "relation_type", "direction")


@query("a16_highest_confidence", f"SELECT edge_id, relation_type FROM (SELECT *, row_number() OVER (PARTITION BY least(claim_id_a, claim_id_b), greatest(claim_id_a, claim_id_b) ORDER BY decision_confidence DESC, edge_id) AS o FROM {sql.EDGES}) WHERE o = 1")
def a16(spark, d):
    return R.resolve_conflicts(typed(spark, d)).select("edge_id", "relation_type")


@query("a16_most_specific", f"SELECT edge_id, candidate_rank FROM (SELECT *, row_number() OVER (PARTITION BY least(claim_id_a, claim_id_b), greatest(claim_id_a, claim_id_b) ORDER BY candidate_rank, edge_id) AS o FROM {sql.EDGES}) WHERE o = 1")
def a16s(spark, d):
    return R.resolve_conflicts(typed(spark, d), "most_specific").select("edge_id", "candidate_rank")


@query("a16_conservative", f"SELECT edge_id FROM (SELECT *, row_number() OVER (PARTITION BY least(claim_id_a, claim_id_b), greatest(claim_id_a, claim_id_b) ORDER BY decision_confidence DESC, edge_id) AS o, min(relation_type) OVER (PARTITION BY least(claim_id_a, claim_id_b), greatest(claim_id_a, claim_id_b)) AS lo, max(relation_type) OVER (PARTITION BY least(claim_id_a, claim_id_b), greatest(claim_id_a, claim_id_b)) AS hi FROM {sql.EDGES}) WHERE o = 1 AND lo = hi")
def a16c(spark, d):
    return R.resolve_conflicts(typed(spark, d), "conservative").select("edge_id")


@query("r12_heuristic", f"""SELECT relationship_id, CASE WHEN na <> nb AND cosine_similarity >= 0.45 THEN 'CONTRADICTS' WHEN cosine_similarity >= 0.75 THEN 'SUPPORTS' ELSE 'NEUTRAL' END AS label FROM (SELECT *, list_has_any(regexp_extract_all(lower(ta), '[a-z'']+'), {NEG}) AS na, list_has_any(regexp_extract_all(lower(tb), '[a-z'']+'), {NEG}) AS nb FROM {PAIRS})""")
def r12(spark, d):
    return pair_texts(spark, d).select("relationship_id", R.heuristic_type(F.col("ta"), F.col("tb"), F.col("cosine_similarity"), 0.75, 0.45).alias("label"))


@query("r13_tfidf_pairs", f"""WITH t AS (SELECT claim_id, w, count(*)::DOUBLE AS tf FROM (SELECT claim_id, unnest(regexp_extract_all(lower(claim_text), '[a-z0-9][a-z0-9]+')) AS w FROM {sql.CLAIMS}) GROUP BY 1, 2), n AS (SELECT count(*)::DOUBLE AS n FROM {sql.CLAIMS}),
 i AS (SELECT w, ln((1 + (SELECT n FROM n)) / (1 + count(*))) + 1 AS idf, count(*) AS df FROM t GROUP BY 1), v AS (SELECT claim_id, w, tf * idf AS x FROM t JOIN i USING (w)), l AS (SELECT claim_id, sqrt(sum(x * x)) AS len FROM v GROUP BY 1),
 p AS (SELECT DISTINCT claim_id_a, claim_id_b FROM relationship_evidence)
 SELECT claim_id_a, claim_id_b, round(sum(a.x * b.x) / (min(la.len) * min(lb.len)), 6) AS similarity FROM p JOIN v a ON a.claim_id = claim_id_a JOIN v b ON b.claim_id = claim_id_b AND b.w = a.w JOIN l la ON la.claim_id = claim_id_a JOIN l lb ON lb.claim_id = claim_id_b GROUP BY 1, 2 HAVING sum(a.x * b.x) / (min(la.len) * min(lb.len)) >= 0.2""")
def r13(spark, d):
    from notegraph.operators.baselines import tfidf_similarity

    pairs = table(spark, d, "relationship_evidence").select("claim_id_a", "claim_id_b").distinct()
    c = records.distinct_claims(table(spark, d, "claims")).select("claim_id", F.col("claim_text").alias("text"))
    return tfidf_similarity(c, pairs, 0.2)


def claim_texts(spark, d):
    return records.distinct_claims(table(spark, d, "claims")).select("claim_id", F.col("claim_text").alias("text"))


@query("r13_tfidf_relations", f"""WITH t AS (SELECT claim_id, w, count(*)::DOUBLE AS tf FROM (SELECT claim_id, unnest(regexp_extract_all(lower(claim_text), '[a-z0-9][a-z0-9]+')) AS w FROM {sql.CLAIMS}) GROUP BY 1, 2), n AS (SELECT count(*)::DOUBLE AS n FROM {sql.CLAIMS}),
 i AS (SELECT w, ln((1 + (SELECT n FROM n)) / (1 + count(*))) + 1 AS idf, count(*) AS df FROM t GROUP BY 1), v AS (SELECT claim_id, w, tf * idf AS x FROM t JOIN i USING (w)), l AS (SELECT claim_id, sqrt(sum(x * x)) AS len FROM v GROUP BY 1),
 neg AS (SELECT claim_id, list_has_any(regexp_extract_all(lower(coalesce(claim_text, '')), '[a-z'']+'), {NEG}) AS neg FROM {sql.CLAIMS}), p AS (SELECT a.claim_id AS claim_id_a, b.claim_id AS claim_id_b FROM l a JOIN l b ON a.claim_id < b.claim_id)
 SELECT claim_id_a, claim_id_b, round(s, 6) AS similarity, CASE WHEN na.neg <> nb.neg THEN 'CONTRADICTS' WHEN s >= 0.55 THEN 'SUPPORTS' ELSE 'NEUTRAL' END AS label FROM (SELECT claim_id_a, claim_id_b, sum(a.x * b.x) / (min(la.len) * min(lb.len)) AS s FROM p JOIN v a ON a.claim_id = claim_id_a JOIN v b ON b.claim_id = claim_id_b AND b.w = a.w JOIN l la ON la.claim_id = claim_id_a JOIN l lb ON lb.claim_id = claim_id_b GROUP BY 1, 2)
 JOIN neg na ON na.claim_id = claim_id_a JOIN neg nb ON nb.claim_id = claim_id_b WHERE s >= 0.2""")
def r13a(spark, d):
    from notegraph.operators.baselines import tfidf_relations

    return tfidf_relations(claim_texts(spark, d))


@query("r13_vector_relations")
def r13v(spark, d):
    from notegraph.operators.baselines import vector_relations

    usable = table(spark, d, "embedded_claims").where(V.problem(F.col("vector"), 96).isNull())
    latest = usable.groupBy("claim_id").agg(F.max(F.struct("embedded_at", "vector"))["vector"].cast("array<double>").alias("vector"))
    return vector_relations(claim_texts(spark, d), latest.select("claim_id", V.l2_normalize(F.col("vector")).alias("vector")))


@query("r15_three_way", f"SELECT relationship_id, CASE relation_type WHEN 'contradicts' THEN 'REFUTES' WHEN 'neutral' THEN 'NOT ENOUGH INFO' WHEN 'unknown' THEN 'NOT ENOUGH INFO' ELSE 'SUPPORTS' END AS label FROM {sql.RESOLVED}")
def r15(spark, d):
    t = F.col("relation_type")
    return R.resolve(flat(spark, d)).select("relationship_id", F.when(t == "contradicts", "REFUTES").when(t.isin("neutral", "unknown"), "NOT ENOUGH INFO").otherwise("SUPPORTS").alias("label"))


@query("r16_corpus_lint", """SELECT issue, count(*) AS n FROM (
 SELECT 'missing_text_b' AS issue FROM v1_pilot_manifest WHERE text_b IS NULL UNION ALL SELECT 'no_final_mark' FROM v1_pilot_manifest WHERE NOT regexp_matches(text_a, '[.!?…]\\s*$')
 UNION ALL SELECT 'family_in_several_splits' FROM (SELECT lower(trim(template_family_id)) AS f FROM v1_pilot_manifest WHERE trim(template_family_id) <> '' GROUP BY 1 HAVING count(DISTINCT lower(trim(split))) > 1)
 UNION ALL SELECT 'duplicate_pair' FROM (SELECT text_a, text_b FROM v1_pilot_manifest GROUP BY 1, 2 HAVING count(*) > 1)) GROUP BY 1""")
def r16(spark, d):
    from notegraph.operators.baselines import lint

    return lint(table(spark, d, "v1_pilot_manifest"))
