"""SQL fragments shared by the DuckDB counterparts."""

from notegraph.functions import lexicon
from notegraph.operators import scoring as S

CLAIMS = """(SELECT claim_id, min(text) AS claim_text, min(context) AS context, min(document_id) AS document_id, min(source_path) AS source_path,
 min(extraction_mode) AS extraction_mode, bool_or(is_negated) AS is_negated, min(modality) AS modality FROM claims WHERE claim_id IS NOT NULL GROUP BY claim_id)"""

FLAT = """(SELECT DISTINCT relationship_id, claim_id_a, claim_id_b, cosine_similarity, candidate_rank,
 ab.entailment_score AS e_ab, ab.neutral_score AS n_ab, ab.contradiction_score AS c_ab,
 ba.entailment_score AS e_ba, ba.neutral_score AS n_ba, ba.contradiction_score AS c_ba, conf_ab, conf_ba, model_name FROM relationship_evidence)"""

RESOLVED = f"""(SELECT *, CASE WHEN relation_type = 'supports' THEN CASE WHEN ab_in THEN 'a_to_b' ELSE 'b_to_a' END ELSE 'symmetric' END AS direction FROM (
 SELECT *, CASE WHEN coalesce(c >= 0.8 AND c - e >= 0 AND c - n >= 0, false) THEN 'contradicts' WHEN ab_in AND ba_in THEN 'equivalent' WHEN ab_in <> ba_in THEN 'supports'
  WHEN coalesce(greatest(n, n_ab, n_ba) >= 0.6, false) THEN 'neutral' ELSE 'unknown' END AS relation_type FROM (
  SELECT *, CASE WHEN e_ba IS NULL THEN c_ab ELSE (c_ab + c_ba) / 2 END AS c, CASE WHEN e_ba IS NULL THEN n_ab ELSE (n_ab + n_ba) / 2 END AS n,
   CASE WHEN e_ba IS NULL THEN e_ab ELSE greatest(e_ab, e_ba) END AS e,
   coalesce(e_ab >= 0.8 AND e_ab - c_ab >= 0 AND e_ab - n_ab >= 0, false) AS ab_in, coalesce(e_ba >= 0.8 AND e_ba - c_ba >= 0 AND e_ba - n_ba >= 0, false) AS ba_in
  FROM {FLAT})))"""

NODES = f"""(SELECT *, NULL::VARCHAR AS anchor_note FROM {CLAIMS} UNION ALL BY NAME SELECT claim_id, min(text) AS claim_text FROM anchor_claims WHERE claim_id NOT IN (SELECT claim_id FROM claims WHERE claim_id IS NOT NULL) GROUP BY 1)"""


def _list(words):
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


STOP = _list(lexicon.STOP_WORDS)
CUES = _list(lexicon.STOP_WORDS + lexicon.ATTRIBUTION_CUES)


def content(x, stop=STOP):
    return f"list_filter(list_distinct(regexp_extract_all(lower({x}), '[a-z0-9]+')), lambda t: length(t) > 3 AND NOT list_contains({stop}, t))"


def caps(x, skip=""):
    return f"list_distinct(list_filter(regexp_extract_all({x}, '[A-Za-z0-9]+'){skip}, lambda t: regexp_matches(t, '^[A-Z]') AND NOT list_contains({STOP}, lower(t))))"


def specificity(t):
    tokens = f"regexp_extract_all({t}, '[A-Za-z0-9_]+')"
    return (
        f"(len({content(t, CUES)}) + 2.0::DOUBLE * len(regexp_extract_all({t}, '[0-9]+(?:\\.[0-9]+)?')) + 2.0::DOUBLE * len(list_filter({tokens}, lambda w: regexp_full_match(w, '(18|19|20)[0-9][0-9]')))"
        f" + 1.5::DOUBLE * len(list_filter({tokens}, lambda w: list_contains({_list(lexicon.MONTHS)}, lower(w)))) + 1.5::DOUBLE * len({caps(t, '[2:]')}))"
    )


_TEXTS = f"(SELECT claim_id, coalesce(claim_text, '') AS t, {content('t')} AS words, {caps('t')} AS names, {specificity('t')} AS spec FROM {NODES})"
GATED = f"""(SELECT * EXCLUDE (relation_type, sa, sb, related), CASE WHEN relation_type = 'contradicts' AND related < 0.03 THEN 'unknown'
 WHEN relation_type = 'supports' AND (CASE WHEN direction = 'a_to_b' THEN sa - sb ELSE sb - sa END) >= 3 THEN 'refines' ELSE relation_type END AS relation_type
 FROM (SELECT r.*, a.spec AS sa, b.spec AS sb, greatest(CASE WHEN len(list_intersect(a.names, b.names)) > 0 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END,
   CASE WHEN len(a.words) = 0 OR len(b.words) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect(a.words, b.words))::DOUBLE / (len(a.words) + len(b.words) - len(list_intersect(a.words, b.words))) END) AS related
  FROM {RESOLVED} r JOIN {_TEXTS} a ON a.claim_id = r.claim_id_a JOIN {_TEXTS} b ON b.claim_id = r.claim_id_b))"""

DECIDED = f"""(SELECT *, CASE WHEN decision_confidence < 0.5 THEN 'confidence_too_low' WHEN relation_type = 'unknown' THEN 'unknown_relationship' WHEN relation_type = 'neutral' THEN 'neutral_relationship'
 WHEN coalesce(e_ab >= 0.8 AND c_ab >= 0.8, false) OR coalesce(e_ba >= 0.8 AND c_ba >= 0.8, false) THEN 'contradictory_evidence' END AS rejection_reason FROM (
 SELECT *, CASE WHEN conf_ba IS NULL THEN conf_ab WHEN relation_type = 'equivalent' THEN least(conf_ab, conf_ba)
  WHEN relation_type IN ('supports', 'refines') THEN CASE WHEN direction = 'a_to_b' THEN conf_ab ELSE conf_ba END ELSE (conf_ab + conf_ba) / 2 END AS decision_confidence FROM {GATED}))"""

EDGES = f"""(SELECT substr(sha256(claim_id_a || ':' || claim_id_b || ':' || relation_type || ':7.0'), 1, 16) AS edge_id, claim_id_a, claim_id_b, relation_type, direction, decision_confidence,
 conf_ab, cosine_similarity, candidate_rank FROM {DECIDED} WHERE rejection_reason IS NULL)"""

LABEL = "CASE WHEN {x} >= 80 THEN 'very_high' WHEN {x} >= 65 THEN 'high' WHEN {x} >= 45 THEN 'moderate' WHEN {x} >= 25 THEN 'low' ELSE 'very_low' END"


# the signed graph: nodes, edges, two colours per contradiction component, partitions
GRAPH_EDGES = f"""(SELECT edge_id, min(claim_id_a) AS source, min(claim_id_b) AS target, min(relation_type) AS relation_type, min(direction) AS direction, min(conf_ab) AS confidence FROM (
 SELECT *, row_number() OVER (PARTITION BY least(claim_id_a, claim_id_b), greatest(claim_id_a, claim_id_b) ORDER BY decision_confidence DESC, edge_id) AS o FROM {EDGES}) WHERE o = 1 GROUP BY 1)"""


def reach(name, pairs, nodes="SELECT claim_id FROM nodes"):
    return f"""{name}e AS (SELECT source AS x, target AS y FROM ({pairs}) UNION SELECT target, source FROM ({pairs})), {name}r(x, y) AS (SELECT claim_id, claim_id FROM ({nodes}) UNION SELECT r.x, e.y FROM {name}r r JOIN {name}e e ON e.x = r.y),
 {name}c AS (SELECT x AS claim_id, min(y) AS component FROM {name}r GROUP BY 1), {name} AS MATERIALIZED (SELECT claim_id, left(sha256(string_agg(claim_id, '|' ORDER BY claim_id) OVER (PARTITION BY component ORDER BY claim_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)), 12) AS partition_id FROM {name}c)"""


BASE = f"nodes AS MATERIALIZED (SELECT * FROM {NODES}), edges AS MATERIALIZED (SELECT * FROM {GRAPH_EDGES})"
COLOUR = """ce AS (SELECT source AS x, target AS y FROM edges WHERE relation_type = 'contradicts' UNION SELECT target, source FROM edges WHERE relation_type = 'contradicts'),
 rp(x, y, par) AS (SELECT DISTINCT x, x, 0 FROM ce UNION SELECT rp.x, ce.y, 1 - rp.par FROM rp JOIN ce ON ce.x = rp.y), root AS (SELECT y AS claim_id, min(x) AS root FROM rp GROUP BY 1),
 colour AS MATERIALIZED (SELECT n.claim_id, CASE WHEN r.claim_id IS NULL THEN '0' WHEN n.claim_id IN (SELECT x FROM rp WHERE x = y AND par = 1) THEN 'x:' || n.claim_id ELSE CAST((SELECT min(par) FROM rp WHERE rp.x = r.root AND rp.y = n.claim_id) AS VARCHAR) END AS colour FROM nodes n LEFT JOIN root r USING (claim_id))"""
KEPT = "SELECT source, target FROM edges JOIN colour a ON a.claim_id = source JOIN colour b ON b.claim_id = target WHERE relation_type IN ('supports', 'refines', 'equivalent') AND a.colour = b.colour"
PARTS = f"WITH RECURSIVE {BASE}, {COLOUR}, kept AS ({KEPT}), {reach('parts', 'SELECT * FROM kept')}"
INNER = "inn AS MATERIALIZED (SELECT e.*, a.partition_id FROM edges e JOIN parts a ON a.claim_id = source JOIN parts b ON b.claim_id = target WHERE a.partition_id = b.partition_id AND relation_type <> 'contradicts'), two AS (SELECT source, target FROM inn UNION ALL SELECT target, source FROM inn WHERE relation_type = 'equivalent')"
TOPOLOGY = """deg AS MATERIALIZED (SELECT p.claim_id, p.partition_id, coalesce(i.n, 0) AS in_degree, coalesce(o.n, 0) AS out_degree FROM parts p LEFT JOIN (SELECT target AS claim_id, count(*) AS n FROM two GROUP BY 1) i USING (claim_id) LEFT JOIN (SELECT source AS claim_id, count(*) AS n FROM two GROUP BY 1) o USING (claim_id)),
 und AS MATERIALIZED (SELECT source AS x, target AS y FROM inn WHERE source <> target UNION SELECT target, source FROM inn WHERE source <> target),
 cut(c, s, y) AS (SELECT DISTINCT a.x, b.y, b.y FROM und a JOIN und b ON b.x = a.x UNION SELECT cut.c, cut.s, und.y FROM cut JOIN und ON und.x = cut.y WHERE und.y <> cut.c),
 bridges AS MATERIALIZED (SELECT DISTINCT a.x AS claim_id FROM und a JOIN und b ON b.x = a.x AND b.y <> a.y WHERE NOT EXISTS (SELECT 1 FROM cut WHERE cut.c = a.x AND cut.s = a.y AND cut.y = b.y)),
 topo AS MATERIALIZED (SELECT *, CASE WHEN is_bridge THEN 'bridge_claim' WHEN centrality >= 0.5 AND in_degree >= 2 THEN 'foundational_claim' WHEN in_degree >= 3 THEN 'evidence_hub' WHEN refines_out >= 2 THEN 'refinement_root' WHEN out_degree = 0 THEN 'leaf_claim' WHEN degree <= 1 THEN 'peripheral_claim' ELSE 'unclassified' END AS semantic_role
  FROM (SELECT claim_id, partition_id, in_degree + out_degree AS degree, in_degree, out_degree, CASE WHEN n > 1 THEN round(in_degree::DOUBLE / (n - 1), 6) ELSE 0.0::DOUBLE END AS centrality, in_degree + out_degree > greatest(1.0, 2 * mean) AS is_hub,
   claim_id IN (SELECT claim_id FROM bridges) AS is_bridge, coalesce(rf.k, 0) AS refines_out FROM deg JOIN (SELECT partition_id, count(*) AS n, avg(in_degree + out_degree) AS mean FROM deg GROUP BY 1) USING (partition_id) LEFT JOIN (SELECT source AS claim_id, count(*) AS k FROM edges WHERE relation_type = 'refines' GROUP BY 1) rf USING (claim_id)))"""
# supporters at their least hop, groups of equivalent supporters, weights 1, .6 and .3
SUPPORT = """se AS MATERIALIZED (SELECT source AS x, target AS y FROM inn WHERE relation_type IN ('supports', 'equivalent') AND source <> target UNION SELECT target, source FROM inn WHERE relation_type = 'equivalent' AND source <> target),
 sh(node, s, hop) AS (SELECT y, x, 1 FROM se UNION SELECT sh.node, se.x, hop + 1 FROM sh JOIN se ON se.y = sh.s WHERE hop < 25 AND se.x <> sh.node), sup AS MATERIALIZED (SELECT node, s, min(hop) AS hop FROM sh WHERE node <> s GROUP BY 1, 2),
 first AS (SELECT s, arg_min(confidence, edge_id) AS conf FROM (SELECT source AS s, confidence, edge_id FROM inn WHERE relation_type IN ('supports', 'equivalent') UNION ALL SELECT target, confidence, edge_id FROM inn WHERE relation_type = 'equivalent') GROUP BY 1),
 eq AS (SELECT source AS a, target AS b FROM inn WHERE relation_type = 'equivalent' UNION SELECT target, source FROM inn WHERE relation_type = 'equivalent'),
 gr(node, a, b) AS (SELECT node, s, s FROM sup UNION SELECT gr.node, gr.a, eq.b FROM gr JOIN eq ON eq.a = gr.b JOIN sup ON sup.node = gr.node AND sup.s = eq.b),
 grouped AS MATERIALIZED (SELECT g.node, g.root, min(hop) AS hop, avg(coalesce(conf, 0)) AS mean FROM (SELECT node, a AS s, min(b) AS root FROM gr GROUP BY 1, 2) g JOIN sup USING (node, s) LEFT JOIN first USING (s) GROUP BY 1, 2),
 support AS MATERIALIZED (SELECT n.claim_id, coalesce(k, 0) AS support_count, coalesce(weighted_confidence, 0.0) AS weighted_confidence, coalesce(discounted_strength, 0.0) AS discounted_strength, coalesce(discounted_confidence, 0.0) AS discounted_confidence, coalesce(n_groups, 0) AS n_groups FROM nodes n
  LEFT JOIN (SELECT node AS claim_id, count(*) AS k, round(avg(coalesce(conf, 0)), 6) AS weighted_confidence FROM sup LEFT JOIN first USING (s) GROUP BY 1) a USING (claim_id)
  LEFT JOIN (SELECT node AS claim_id, count(*) AS n_groups, round(sum(w), 6) AS discounted_strength, round(sum(w * mean) / sum(w), 6) AS discounted_confidence FROM (SELECT *, CASE WHEN hop = 1 THEN 1.0 WHEN hop = 2 THEN 0.6 ELSE 0.3 END::DOUBLE AS w FROM grouped) GROUP BY 1) b USING (claim_id))"""
TIMES = "(SELECT c.claim_id, coalesce(c.ts, d.modified_at) AS ts FROM (SELECT claim_id, min(claim_ts) AS ts, min(document_id) AS document_id FROM claims GROUP BY 1) c LEFT JOIN documents d ON d.doc_key = c.document_id)"
TEMPORAL = f"""times AS MATERIALIZED (SELECT claim_id, epoch_us(ts) / 86400000000.0::DOUBLE AS day FROM {TIMES}), contra AS (SELECT edge_id, source, target FROM edges WHERE relation_type = 'contradicts' AND source <> target),
 cends AS (SELECT edge_id, source AS claim_id, target AS other FROM contra UNION ALL SELECT edge_id, target, source FROM contra), clast AS (SELECT claim_id, arg_max(other, edge_id) AS counterpart FROM cends WHERE edge_id IN (SELECT min(edge_id) FROM cends GROUP BY claim_id) GROUP BY 1),
 temporal AS MATERIALIZED (SELECT n.claim_id, CASE WHEN l.claim_id IS NULL THEN 'static_partition' WHEN a.day IS NULL OR b.day IS NULL THEN 'no_timestamp' WHEN abs(a.day - b.day) < 1 THEN 'unresolved' ELSE 'evolution' END AS temporal_status,
  CASE WHEN abs(a.day - b.day) >= 1 THEN round(least(1.0, abs(a.day - b.day) / 30.0::DOUBLE), 3) ELSE 0.0 END AS temporal_confidence, round(abs(a.day - b.day), 2) AS time_delta_days, l.counterpart FROM nodes n LEFT JOIN clast l USING (claim_id) LEFT JOIN times a ON a.claim_id = l.claim_id LEFT JOIN times b ON b.claim_id = l.counterpart)"""
SIGNALS_CTE = """whole AS MATERIALIZED (SELECT s.*, coalesce(src.n_sources, 0) AS n_sources, coalesce(src.n_publishers, 0) AS n_publishers, coalesce(cf.k, 0) AS contradictions, coalesce(cf.c, 0.0) AS contradiction_confidence, centrality, is_hub, is_bridge, temporal_status, temporal_confidence
  FROM support s JOIN topo USING (claim_id) JOIN temporal USING (claim_id)
  LEFT JOIN (SELECT g.node AS claim_id, count(DISTINCT coalesce(d.notebook_id, n.document_id, n.claim_id)) AS n_sources, count(DISTINCT coalesce(lower(d.source), regexp_replace(n.source_path, '/[^/]*$', ''))) AS n_publishers FROM grouped g JOIN nodes n ON n.claim_id = g.root LEFT JOIN documents d ON d.doc_key = n.document_id GROUP BY 1) src USING (claim_id)
  LEFT JOIN (SELECT claim_id, count(*) AS k, avg(confidence) AS c FROM (SELECT source AS claim_id, confidence FROM edges WHERE relation_type = 'contradicts' UNION ALL SELECT target, confidence FROM edges WHERE relation_type = 'contradicts' AND source <> target) GROUP BY 1) cf USING (claim_id)),
 most AS (SELECT greatest(1, max(support_count))::DOUBLE AS ms, greatest(1, max(n_sources))::DOUBLE AS mo, greatest(1, max(contradictions))::DOUBLE AS mc FROM whole),
 raw AS MATERIALIZED (SELECT claim_id, CASE WHEN support_count = 0 THEN 0.0 ELSE least(1.0, greatest(0.0, 0.7::DOUBLE * ln(1 + discounted_strength) / ln(1 + ms) + 0.3::DOUBLE * discounted_confidence)) END::DOUBLE AS evidence_strength,
  CASE WHEN n_groups > 0 THEN CASE WHEN blend < 0.5 THEN blend * 0.7::DOUBLE ELSE blend END END AS evidence_independence, ln(1 + n_sources::DOUBLE) / ln(1 + mo) AS source_diversity, centrality AS topology_strength, is_hub::INTEGER::DOUBLE AS hub_score, is_bridge::INTEGER::DOUBLE AS bridge_score,
  CASE WHEN contradictions = 0 THEN 0.0 ELSE least(1.0, (ln(1 + contradictions::DOUBLE) / ln(1 + mc)) / 0.8::DOUBLE) * (0.7::DOUBLE + 0.3::DOUBLE * contradiction_confidence) END::DOUBLE AS conflict_pressure,
  CASE temporal_status WHEN 'evolution' THEN least(1.0, 0.65::DOUBLE + 0.1::DOUBLE * CASE WHEN temporal_confidence > 0 THEN temporal_confidence ELSE 0.5 END) WHEN 'static_partition' THEN 0.5 WHEN 'unresolved' THEN 0.4 END::DOUBLE AS temporal_stability
  FROM (SELECT *, 0.5::DOUBLE * n_sources / greatest(n_groups, 1) + 0.5::DOUBLE * n_publishers / greatest(n_groups, 1) AS blend FROM whole) CROSS JOIN most)"""
SCORING = f"{PARTS}, {INNER}, {TOPOLOGY}, {SUPPORT}, {TEMPORAL}, {SIGNALS_CTE}"
SIGNALS = f"({SCORING} SELECT * FROM raw)"


def g(s):
    """A signal as it enters the fusion."""
    return f"CASE WHEN {s} IS NULL OR isnan({s}) OR isinf({s}) THEN 0.0 ELSE least(1.0, greatest(0.0, {s})) END::DOUBLE"


def part(profile, s, without=None, family=S.EVIDENCE):
    """What one signal of a family contributes."""
    w = S.family_weights(profile, family)
    v = g(s)
    if s == "evidence_strength" and "evidence_independence" in w and without != "evidence_independence":
        v = f"(CASE WHEN {g('evidence_independence')} < 0.5 THEN {v} * 0.7::DOUBLE ELSE {v} END)"
    return f"{v} * ({(-100.0 if s in S.NEGATIVE else 100.0) * w[s]!r})::DOUBLE"


def total(profile, family, without=None):
    """The weighted sum of a family of signals."""
    return " + ".join(["0.0::DOUBLE", *(part(profile, s, without, family) for s in S.family_weights(profile, family) if s != without)])


def scored(profile="balanced", raw=SIGNALS):
    """Claims with their index, importance, uncertainty and completeness, unrounded, and the label."""
    e, i = total(profile, S.EVIDENCE), total(profile, S.IMPORTANCE)
    cap = f"CASE WHEN {g('conflict_pressure')} >= 0.9 THEN least(x, 40.0) ELSE x END"
    complete = "(" + " + ".join(f"CASE WHEN {s} IS NULL OR isnan({s}) OR isinf({s}) THEN 0.0 ELSE 1.0 END" for s in S.SIGNALS) + ")::DOUBLE / 8"
    return f"""(SELECT *, {LABEL.format(x="reliability_index")} AS calibration_label FROM (SELECT *, least(100.0, greatest(0.0, {cap})) AS reliability_index, least(100.0, greatest(0.0, imp)) AS importance_index, cmpl AS evidence_completeness,
 least(100.0, greatest(0.0, 100 * (0.35::DOUBLE * (1 - cmpl) + 0.2::DOUBLE * (1 - {g('source_diversity')}) + 0.2::DOUBLE * (1 - {g('evidence_independence')}) + 0.25::DOUBLE * {g('conflict_pressure')}))) AS uncertainty_score
 FROM (SELECT *, CASE WHEN {g('evidence_strength')} < 0.1 THEN least({e}, 60.0) ELSE {e} END AS x, {i} AS imp, {complete} AS cmpl FROM {raw})))"""


RECORDS = f"""({SCORING} SELECT n.claim_id, n.claim_text, n.context, n.document_id, n.source_path, n.extraction_mode, n.is_negated, n.modality, t.partition_id, t.semantic_role, t.degree, t.in_degree, t.centrality, t.is_hub, t.is_bridge, s.support_count, s.weighted_confidence,
 m.temporal_status, m.temporal_confidence, m.time_delta_days, round(r.reliability_index, 6) AS reliability_index, round(r.uncertainty_score, 6) AS uncertainty_score, r.evidence_completeness, r.calibration_label, 'balanced' AS policy_version, round(r.evidence_strength, 6) AS evidence_strength, round(r.conflict_pressure, 6) AS conflict_pressure
 FROM nodes n JOIN topo t USING (claim_id) JOIN support s USING (claim_id) JOIN temporal m USING (claim_id) JOIN {scored("balanced", "raw")} r USING (claim_id))"""


def ungated(text: str) -> str:
    """The same with contradictions between unrelated texts kept."""
    return text.replace("related < 0.03", "related < 0.0")
