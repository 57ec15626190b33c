"""Queries of the evaluation analytics."""

from pyspark.sql import functions as F

from notegraph.functions import text as T
from notegraph.operators import evaluation as E
from notegraph.operators import relations as R
from notegraph.plans import q_text, sql
from notegraph.plans.base import flat, nodes_of, typed
from notegraph.plans.registry import query
from notegraph.session import table

VALID = "upper(trim(label)) IN ('NEUTRAL', 'SUPPORTS', 'REFINES', 'CONTRADICTS', 'EQUIVALENT')"
BOTH = f"(SELECT a.id, a.label AS gold, b.label AS predicted FROM (SELECT id, min(upper(trim(label))) AS label FROM pass1_relationships WHERE {VALID} GROUP BY 1) a JOIN (SELECT id, min(upper(trim(label))) AS label FROM pass2_relationships WHERE {VALID} GROUP BY 1) b USING (id))"


def both(spark, d):
    def one(i, name):
        label = F.upper(F.trim("label"))
        t = table(spark, d, f"pass{i}_relationships").where(label.isin("NEUTRAL", "SUPPORTS", "REFINES", "CONTRADICTS", "EQUIVALENT"))
        return t.groupBy("id").agg(F.min(label).alias(name))

    return one(1, "gold").join(one(2, "predicted"), "id")


PRF = f"""(SELECT coalesce(g.label, p.label) AS label, coalesce(tp, 0) AS tp, coalesce(said, 0) - coalesce(tp, 0) AS fp, coalesce(support, 0) - coalesce(tp, 0) AS fn, coalesce(support, 0) AS support, coalesce(said, 0) AS said
 FROM (SELECT gold AS label, count(*) AS support, count(*) FILTER (WHERE gold = predicted) AS tp FROM {BOTH} GROUP BY 1) g FULL JOIN (SELECT predicted AS label, count(*) AS said FROM {BOTH} GROUP BY 1) p ON g.label = p.label)"""
PR = f"(SELECT *, CASE WHEN said > 0 THEN tp::DOUBLE / said ELSE 0 END AS pp, CASE WHEN support > 0 THEN tp::DOUBLE / support ELSE 0 END AS rr FROM {PRF})"
F1 = f"(SELECT label, tp, fp, fn, support, round(pp, 6) AS precision, round(rr, 6) AS recall, round(CASE WHEN pp + rr > 0 THEN 2 * pp * rr / (pp + rr) ELSE 0 END, 6) AS f1 FROM {PR})"


@query("a17_prf", f"SELECT * FROM {F1}")
def a17(spark, d):
    return E.prf(both(spark, d))


@query("a17_averages", f"SELECT round(avg(f1) FILTER (WHERE support > 0), 6) AS macro_f1, round(2.0::DOUBLE * sum(tp) / greatest(1, 2 * sum(tp) + sum(fp) + sum(fn)), 6) AS micro_f1 FROM {F1}")
def a17m(spark, d):
    return E.averages(E.prf(both(spark, d)))


@query("a17_confusion", f"SELECT gold, predicted, count(*) AS n FROM {BOTH} GROUP BY 1, 2")
def a17c(spark, d):
    return E.confusion(both(spark, d))


@query("a18_kappa", f"SELECT n, round(po, 6) AS observed, round(pe, 6) AS expected, round((po - pe) / (1 - pe), 6) AS kappa FROM (SELECT count(*) AS n, avg(CASE WHEN gold = predicted THEN 1.0 ELSE 0.0 END::DOUBLE) AS po, (SELECT sum(x * y) FROM (SELECT gold AS l, count(*)::DOUBLE AS x FROM {BOTH} GROUP BY 1) JOIN (SELECT predicted AS l, count(*)::DOUBLE AS y FROM {BOTH} GROUP BY 1) USING (l)) / (count(*)::DOUBLE * count(*)) AS pe FROM {BOTH})")
def a18(spark, d):
    return E.kappa(both(spark, d), "gold", "predicted")


@query("a19_rank_difference", "SELECT round(avg(abs(a.candidate_rank - b.candidate_rank)), 6) AS mean_abs_diff FROM (SELECT claim_id_a, claim_id_b, max(candidate_rank) AS candidate_rank FROM candidate_pairs GROUP BY 1, 2) a JOIN (SELECT DISTINCT claim_id_a, claim_id_b, candidate_rank FROM relationship_evidence) b USING (claim_id_a, claim_id_b)")
def a19(spark, d):
    a = table(spark, d, "candidate_pairs").groupBy("claim_id_a", "claim_id_b").agg(F.max("candidate_rank").alias("x"))
    b = table(spark, d, "relationship_evidence").select("claim_id_a", "claim_id_b", F.col("candidate_rank").alias("y")).distinct()
    return a.join(b, ["claim_id_a", "claim_id_b"]).agg(F.round(F.avg(F.abs(F.col("x") - F.col("y"))), 6).alias("mean_abs_diff"))


LAB = "CASE WHEN c_{d} = greatest(e_{d}, n_{d}, c_{d}) THEN 'c' WHEN e_{d} = greatest(e_{d}, n_{d}, c_{d}) THEN 'e' ELSE 'n' END"
CAL = f"(SELECT relationship_id, conf_ab, e_ab, n_ab, c_ab, {LAB.format(d='ab')} = {LAB.format(d='ba')} AS correct FROM {sql.FLAT} WHERE e_ba IS NOT NULL AND conf_ab IS NOT NULL)"


def cal(spark, d):
    r = R.flat_evidence(table(spark, d, "relationship_evidence")).where("e_ba is not null and conf_ab is not null")
    x, y = (R.predicted_label(*[F.col(f"{k}_{w}") for k in "enc"]) for w in ("ab", "ba"))
    return r.withColumn("correct", x == y)


@query("a20_calibration", f"SELECT round(sum(n * abs(mc - ma)) / sum(n), 6) AS ece, round(sum(b) / sum(n), 6) AS brier, round(sum(l) / sum(n), 6) AS nll FROM (SELECT least(floor(conf_ab * 10), 9) AS bin, count(*) AS n, avg(conf_ab) AS mc, avg(y) AS ma, sum((conf_ab - y) * (conf_ab - y)) AS b, sum(-(y * ln(greatest(conf_ab, 1e-12)) + (1 - y) * ln(greatest(1 - conf_ab, 1e-12)))) AS l FROM (SELECT *, CASE WHEN correct THEN 1.0 ELSE 0.0 END::DOUBLE AS y FROM {CAL}) GROUP BY 1)")
def a20(spark, d):
    return E.calibration(cal(spark, d), "conf_ab", "correct")


@query("a20_reliability_diagram", f"SELECT least(floor(conf_ab * 10), 9)::INTEGER AS bin, count(*) AS n, round(avg(conf_ab), 6) AS mean_confidence, round(avg(CASE WHEN correct THEN 1.0 ELSE 0.0 END::DOUBLE), 6) AS accuracy FROM {CAL} GROUP BY 1")
def a20d(spark, d):
    return E.reliability_diagram(cal(spark, d), "conf_ab", "correct")


def _grid(first, step, last):
    t = f"round({first}::DOUBLE + i * {step}::DOUBLE, 6)"
    p = lambda x: f"exp(ln(greatest({x}, 1e-12)) / {t})"
    return f"""SELECT t AS temperature, round(avg(-(y * ln(p) + (1 - y) * ln(1 - p))), 6) AS nll FROM (SELECT t, y, least(greatest(greatest(pe, pn, pc) / (pe + pn + pc), 1e-12), 1 - 1e-12) AS p FROM (SELECT {t} AS t, CASE WHEN correct THEN 1.0 ELSE 0.0 END::DOUBLE AS y,
 {p('e_ab')} AS pe, {p('n_ab')} AS pn, {p('c_ab')} AS pc FROM {CAL} CROSS JOIN generate_series(0, {last}) s(i))) GROUP BY 1"""


# below .3 the least probabilities leave the range of doubles in one of the two forms of the softmax
@query("a21_temperature", f"SELECT * FROM ({_grid(0.05, 0.02, 247)}) WHERE temperature >= 0.3")
def a21(spark, d):
    return E.temperature_grid(cal(spark, d), "e_ab", "n_ab", "c_ab", "correct").where("temperature >= 0.3")


@query("a21_fitted", f"SELECT * FROM ({_grid(0.05, 0.02, 247)}) WHERE temperature >= 0.3 ORDER BY nll, temperature LIMIT 1")
def a21f(spark, d):
    return E.fit_temperature(E.temperature_grid(cal(spark, d), "e_ab", "n_ab", "c_ab", "correct"))


RC = f"(SELECT p AS point, round(r::DOUBLE / n, 6) AS coverage, round(err::DOUBLE / r, 6) AS risk FROM (SELECT row_number() OVER w AS r, sum(CASE WHEN correct THEN 0 ELSE 1 END) OVER (ORDER BY conf_ab DESC, relationship_id ROWS UNBOUNDED PRECEDING) AS err, count(*) OVER () AS n FROM {CAL} WINDOW w AS (ORDER BY conf_ab DESC, relationship_id)) JOIN (SELECT p::INTEGER AS p, greatest(1, round_even(p * (SELECT count(*) FROM {CAL})::DOUBLE / 20, 0))::BIGINT AS q FROM generate_series(1, 20) s(p)) ON q = r)"


@query("w07_risk_coverage", f"SELECT * FROM {RC}")
def w07(spark, d):
    return E.risk_coverage(cal(spark, d), "conf_ab", "correct", "relationship_id")


@query("w07_aurc", f"SELECT round(sum(dx * y), 6) AS aurc FROM (SELECT coverage - lag(coverage) OVER (ORDER BY coverage, point) AS dx, (risk + lag(risk) OVER (ORDER BY coverage, point)) / 2 AS y FROM {RC})")
def w07a(spark, d):
    return E.aurc(E.risk_coverage(cal(spark, d), "conf_ab", "correct", "relationship_id"))


# the interval of a mean lies about 1.96 standard errors around it
@query("a25_bootstrap_near_normal", f"SELECT count(*) AS n, round(avg(y), 6) AS estimate, true AS near_normal FROM (SELECT CASE WHEN correct THEN 1.0 ELSE 0.0 END::DOUBLE AS y FROM {CAL})")
def a25n(spark, d):
    r = cal(spark, d)
    half = r.agg((1.96 * F.stddev_pop(F.col("correct").cast("double")) / F.sqrt(F.count("*"))).alias("half"))
    b = E.bootstrap(r, "correct").crossJoin(half)  # one row each
    off = F.greatest(F.abs(F.col("ci_low") - (F.col("estimate") - F.col("half"))), F.abs(F.col("ci_high") - (F.col("estimate") + F.col("half"))))
    return b.select("n", F.round("estimate", 6).alias("estimate"), (off < 0.25 * F.col("half")).alias("near_normal"))


@query("a25_bootstrap")
def a25(spark, d):
    return E.bootstrap(cal(spark, d), "correct")


@query("a25_bootstrap_clustered")
def a25c(spark, d):
    return E.bootstrap(cal(spark, d), "correct", "claim_id_a")


def _axis(x):
    return f"CASE WHEN {x} IN {E.FORWARD} THEN 'A_TO_B' WHEN {x} IN {E.BACKWARD} THEN 'B_TO_A' WHEN {x} = 'SYMMETRIC' THEN 'SYMMETRIC' END"


def _pass(i):
    return f"(SELECT id, min(upper(trim(label))) AS label, min({_axis('upper(trim(direction))')}) AS way FROM pass{i}_relationships WHERE {VALID} GROUP BY 1)"


DIRECTIONS = f"(SELECT a.label AS gl, a.way AS gw, b.label AS l, b.way AS w, a.label IN {E.DIRECTED} AS dir, coalesce(a.label = b.label, false) AS lok, coalesce(a.way = b.way, false) AS wok FROM {_pass(1)} a JOIN {_pass(2)} b USING (id))"
_KINDS = {"D1": ("dir", "lok AND wok"), "D2": ("dir", "wok"), "D3": ("true", "lok AND (wok OR NOT dir)"), "D4": ("dir AND lok", "wok")}


@query("a32_direction", f"""SELECT metric, n, k, round(r, 6) AS rate, round(greatest(0.0, m - h), 6) AS ci_low, round(least(1.0, m + h), 6) AS ci_high FROM (SELECT *, (r + 3.8416::DOUBLE / (2 * c)) / (1 + 3.8416::DOUBLE / c) AS m, 1.96::DOUBLE / (1 + 3.8416::DOUBLE / c) * sqrt(r * (1 - r) / c + 3.8416::DOUBLE / (4 * c * c)) AS h
 FROM (SELECT *, greatest(1, n)::DOUBLE AS c, k::DOUBLE / greatest(1, n) AS r FROM ({" UNION ALL ".join(f"SELECT '{m}' AS metric, count(*) FILTER (WHERE {a}) AS n, count(*) FILTER (WHERE {a} AND {b}) AS k FROM {DIRECTIONS}" for m, (a, b) in _KINDS.items())})))""")
def a32(spark, d):
    def one(i, label, way):
        t = table(spark, d, f"pass{i}_relationships").withColumn("l", F.upper(F.trim("label")))
        return t.where(F.col("l").isin("NEUTRAL", "SUPPORTS", "REFINES", "CONTRADICTS", "EQUIVALENT")).groupBy("id").agg(F.min("l").alias(label), F.min(E.axis(F.col("direction"))).alias(way))

    return E.direction_metrics(one(1, "gold_label", "gold_direction").join(one(2, "label", "direction"), "id"))


_MISS = f"""(SELECT g.id, g.gold, r.relation_type AS predicted, a.claim_text AS ta, b.claim_text AS tb, CASE WHEN g.gold = 'CONTRADICTS' THEN r.c_ab WHEN g.gold = 'NEUTRAL' THEN r.n_ab ELSE r.e_ab END AS sa, CASE WHEN g.gold = 'CONTRADICTS' THEN r.c_ba WHEN g.gold = 'NEUTRAL' THEN r.n_ba ELSE r.e_ba END AS sb
 FROM (SELECT id, min(upper(trim(label))) AS gold FROM pass1_relationships WHERE {VALID} GROUP BY 1) g LEFT JOIN {sql.GATED} r ON r.relationship_id = g.id LEFT JOIN {sql.NODES} a ON a.claim_id = r.claim_id_a LEFT JOIN {sql.NODES} b ON b.claim_id = r.claim_id_b)"""


@query("a33_error_taxonomy", f"""SELECT gold, reason, count(*) AS n FROM (SELECT gold, CASE WHEN gold = upper(predicted) THEN NULL WHEN sa IS NULL AND sb IS NULL THEN 'never_scored' WHEN ta IS NULL OR tb IS NULL OR regexp_matches(trim(ta), '{E.MALFORMED}') OR regexp_matches(trim(tb), '{E.MALFORMED}') THEN 'malformed_claim'
 WHEN coalesce(sa, 0) < 0.5 AND coalesce(sb, 0) < 0.5 THEN 'model_missed' ELSE 'routing' END AS reason FROM {_MISS}) GROUP BY 1, 2""")
def a33(spark, d):
    label = F.upper(F.trim("label"))
    gold = table(spark, d, "pass1_relationships").where(label.isin("NEUTRAL", "SUPPORTS", "REFINES", "CONTRADICTS", "EQUIVALENT")).groupBy(F.col("id").alias("relationship_id")).agg(F.min(label).alias("gold"))
    texts = nodes_of(spark, d).select("claim_id", F.col("claim_text").alias("text"))
    r = gold.join(R.apply_gates(R.resolve(flat(spark, d)), texts), "relationship_id", "left")
    score = lambda x: F.when(F.col("gold") == "CONTRADICTS", F.col(f"c_{x}")).when(F.col("gold") == "NEUTRAL", F.col(f"n_{x}")).otherwise(F.col(f"e_{x}"))
    reason = E.error_reason(F.col("gold"), F.upper("relation_type"), F.col("text_a"), F.col("text_b"), score("ab"), score("ba"))
    return r.groupBy("gold", reason.alias("reason")).agg(F.count("*").alias("n"))


def term(x):
    return f"CASE WHEN {x} > 0 THEN -{x} * ln({x}) / ln(3.0::DOUBLE) ELSE 0 END"


@query("a34_entropy", f"SELECT relation_type, round(avg({term('e_ab')} + {term('n_ab')} + {term('c_ab')}), 4) AS mean_entropy, round(avg(n_ab - greatest(e_ab, c_ab)), 4) AS neutral_margin FROM {sql.RESOLVED} GROUP BY 1")
def a34(spark, d):
    r = R.resolve(R.flat_evidence(table(spark, d, "relationship_evidence")))
    return r.groupBy("relation_type").agg(F.round(F.avg(E.entropy3(F.col("e_ab"), F.col("n_ab"), F.col("c_ab"))), 4).alias("mean_entropy"), F.round(F.avg(F.col("n_ab") - F.greatest("e_ab", "c_ab")), 4).alias("neutral_margin"))


@query("a36_verification_index", "SELECT round(v, 6) AS \"index\", CASE WHEN v >= 95 THEN 'exemplary' WHEN v >= 85 THEN 'strong' WHEN v >= 75 THEN 'adequate' WHEN v >= 60 THEN 'partial' WHEN v >= 40 THEN 'weak' ELSE 'insufficient' END AS level FROM (SELECT 100 * sum(rate * w) / sum(w) AS v FROM (SELECT category, avg(CASE WHEN gold_relationship = 'CONTRADICTS' THEN 1.0 ELSE 0.0 END::DOUBLE) AS rate FROM v1_pilot_manifest WHERE gold_relationship IS NOT NULL GROUP BY 1) JOIN (SELECT * FROM (VALUES ('direct', 0.5::DOUBLE), ('numeric', 0.3), ('refines', 0.2)) t(category, w)) USING (category))")
def a36(spark, d):
    r = table(spark, d, "v1_pilot_manifest").select(F.col("category").alias("dimension"), (F.col("gold_relationship") == "CONTRADICTS").alias("passed"))
    return E.verification_index(r, {"direct": 0.5, "numeric": 0.3, "refines": 0.2})


@query("a37_evidence_conflicts", f"SELECT claim_id_a AS claim, up * down AS n_conflicts, round(least(1.0, 0.1::DOUBLE * up * down), 6) AS penalty FROM (SELECT claim_id_a, count(*) FILTER (WHERE conf_ab >= 0.5) AS up, count(*) FILTER (WHERE conf_ab < 0.5) AS down FROM {sql.FLAT} GROUP BY 1) WHERE up * down > 0")
def a37(spark, d):
    return E.evidence_conflicts(R.flat_evidence(table(spark, d, "relationship_evidence")), "claim_id_a", "conf_ab")


@query("a41_gate_evaluation", f"""SELECT tp, fp, fn, tn, round(tp::DOUBLE / greatest(1, tp + fp), 6) AS precision, round(tp::DOUBLE / greatest(1, tp + fn), 6) AS recall, round(2.0::DOUBLE * tp / greatest(1, 2 * tp + fp + fn), 6) AS f1, round((tp + tn)::DOUBLE / greatest(1, tp + fp + fn + tn), 6) AS accuracy,
 round((2.0::DOUBLE * tp / greatest(1, 2 * tp + fp + fn) + 2.0::DOUBLE * tn / greatest(1, 2 * tn + fp + fn)) / 2, 6) AS macro_f1 FROM (SELECT count(*) FILTER (WHERE g AND p) AS tp, count(*) FILTER (WHERE NOT g AND p) AS fp, count(*) FILTER (WHERE g AND NOT p) AS fn, count(*) FILTER (WHERE NOT g AND NOT p) AS tn
 FROM (SELECT block_type IN ('paragraph', 'bullet_item', 'ordered_item') AS g, {q_text.GATE} = 'declarative_assertion' AS p FROM (SELECT event_id, block_type, regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g') AS t FROM {q_text.EVENTS})))""")
def a41(spark, d):
    e = q_text.events(spark, d)
    gold = F.col("block_type").isin("paragraph", "bullet_item", "ordered_item")
    return E.binary(e.select(gold.alias("gold"), (T.assertion_type(F.col("text"), F.col("block_type")) == "declarative_assertion").alias("said")), "gold", "said")


@query("a45_coverage_by_category", "SELECT category, round(avg(CASE WHEN gold_relationship IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE), 6) AS coverage, count(*) FILTER (WHERE gold_relationship = 'NEUTRAL') AS n_neutral FROM v1_pilot_manifest GROUP BY 1")
def a45(spark, d):
    m = table(spark, d, "v1_pilot_manifest")
    return m.groupBy("category").agg(F.round(F.avg(F.col("gold_relationship").isNotNull().cast("double")), 6).alias("coverage"), F.count_if(F.col("gold_relationship") == "NEUTRAL").alias("n_neutral"))


@query("a44_model_comparison", f"SELECT model_name, count(*) AS n, round(avg(conf_ab), 6) AS mean_confidence, round(avg(CASE WHEN relation_type IN ('unknown') THEN 1.0 ELSE 0.0 END::DOUBLE), 6) AS abstention FROM {sql.RESOLVED} GROUP BY 1")
def a44(spark, d):
    r = R.resolve(R.flat_evidence(table(spark, d, "relationship_evidence")))
    return r.groupBy("model_name").agg(F.count("*").alias("n"), F.round(F.avg("conf_ab"), 6).alias("mean_confidence"), F.round(F.avg((F.col("relation_type") == "unknown").cast("double")), 6).alias("abstention"))


@query("a46_gate_ladder", "SELECT gate, position, CASE WHEN failed = 0 THEN 'passed' WHEN failed = 1 AND NOT passed THEN 'blocked' ELSE 'not reached' END AS state FROM (SELECT *, sum(CASE WHEN passed THEN 0 ELSE 1 END) OVER (ORDER BY position) AS failed FROM (SELECT category AS gate, row_number() OVER (ORDER BY category)::INTEGER AS position, count(*) >= 40 AS passed FROM v1_pilot_manifest WHERE category IS NOT NULL GROUP BY 1))")
def a46(spark, d):
    from pyspark.sql import Window

    g = table(spark, d, "v1_pilot_manifest").where("category is not null").groupBy(F.col("category").alias("gate")).agg((F.count("*") >= 40).alias("passed"))
    return E.gate_ladder(g.withColumn("position", F.row_number().over(Window.orderBy("gate"))))


@query("w08_family_split", "SELECT category, family, CASE WHEN r <= greatest(1, round_even(0.35::DOUBLE * n, 0)) THEN 'test' ELSE 'dev' END AS split FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY sha256(family), family) AS r, count(*) OVER (PARTITION BY category) AS n FROM (SELECT DISTINCT category, template_family_id AS family FROM v1_pilot_manifest WHERE category IS NOT NULL AND template_family_id IS NOT NULL))")
def w08(spark, d):
    return E.family_split(table(spark, d, "v1_pilot_manifest"), "category", "template_family_id")


@query("w09_quotas", "SELECT stratum, n, least(n, base + CASE WHEN r <= 100 - sum(base) OVER () THEN 1 ELSE 0 END)::BIGINT AS quota FROM (SELECT *, row_number() OVER (ORDER BY exact - base DESC, stratum) AS r FROM (SELECT stratum, n, 100.0::DOUBLE * n / sum(n) OVER () AS exact, floor(100.0::DOUBLE * n / sum(n) OVER ())::BIGINT AS base FROM (SELECT category AS stratum, count(*) AS n FROM v1_pilot_manifest GROUP BY 1)))")
def w09(spark, d):
    return E.quotas(table(spark, d, "v1_pilot_manifest"), "category", 100)


QUOTAS = "(SELECT stratum, n, least(n, base + CASE WHEN r <= 100 - sum(base) OVER () THEN 1 ELSE 0 END)::BIGINT AS quota FROM (SELECT *, row_number() OVER (ORDER BY exact - base DESC, stratum) AS r FROM (SELECT stratum, n, 100.0::DOUBLE * n / sum(n) OVER () AS exact, floor(100.0::DOUBLE * n / sum(n) OVER ())::BIGINT AS base FROM (SELECT category AS stratum, count(*) AS n FROM v1_pilot_manifest GROUP BY 1))))"


@query("w09_stratified_sample", f"SELECT row_id, category FROM (SELECT row_id, category, row_number() OVER (PARTITION BY category ORDER BY sha256('sample:' || row_id), row_id) AS o FROM v1_pilot_manifest) JOIN {QUOTAS} ON stratum IS NOT DISTINCT FROM category WHERE o <= quota")
def w09s(spark, d):
    return E.stratified_sample(table(spark, d, "v1_pilot_manifest"), "category", "row_id", 100).select("row_id", "category")


@query("w09b_template_held_out", "SELECT row_id, template_family_id, coalesce(trim(template_family_id) <> '' AND ('0x' || left(sha256('held-out:' || lower(trim(template_family_id))), 8))::BIGINT < 858993459, false) AS held_out FROM v1_pilot_manifest")
def w09h(spark, d):
    return E.template_held_out(table(spark, d, "v1_pilot_manifest"), "template_family_id").select("row_id", "template_family_id", "held_out")


@query("a30_retrieval_benchmark", """WITH rel AS (SELECT DISTINCT claim_id_a AS q, claim_id_b AS i FROM candidate_pairs WHERE below_threshold = false AND claim_id_a IS NOT NULL AND claim_id_b IS NOT NULL), per AS (SELECT q, count(*) AS nr FROM rel GROUP BY 1),
 top AS (SELECT claim_id_a AS q, claim_id_b AS i, min(candidate_rank) AS r FROM candidate_pairs WHERE candidate_rank <= 10 GROUP BY 1, 2), got AS (SELECT q, count(*) AS hits, min(r) AS first, sum(1.0::DOUBLE / log2(r + 1)) AS dcg FROM top JOIN rel USING (q, i) GROUP BY 1),
 ideal AS (SELECT q, sum(1.0::DOUBLE / log2(s.i + 1)) AS idcg FROM per, generate_series(1, 10) s(i) WHERE s.i <= nr GROUP BY 1)
 SELECT count(*) AS n_queries, round(avg(coalesce(hits / 10.0::DOUBLE, 0)), 6) AS precision, round(avg(coalesce(hits::DOUBLE / nr, 0)), 6) AS recall, round(avg(coalesce(1.0::DOUBLE / first, 0)), 6) AS mrr, round(avg(coalesce(dcg, 0) / idcg), 6) AS ndcg FROM per LEFT JOIN got USING (q) JOIN ideal USING (q)""")
def a30(spark, d):
    p = table(spark, d, "candidate_pairs").select(F.col("claim_id_a").alias("query"), F.col("claim_id_b").alias("item"), F.col("candidate_rank").alias("rank"), "below_threshold")
    return E.retrieval_benchmark(p, p.where("below_threshold = false"))


@query("a35_evidence_coverage", """SELECT round(100 * (0.25 * c + 0.2 * r + 0.1 * a + 0.1 * s), 6) AS coverage, 2 + (c < 1)::BIGINT + (r < 1)::BIGINT + (a < 1)::BIGINT + (s < 1)::BIGINT AS n_missing FROM (SELECT (SELECT count(context)::DOUBLE / count(*) FROM claims) AS c, (SELECT count(ba)::DOUBLE / count(*) FROM relationship_evidence) AS r,
 (SELECT count(text)::DOUBLE / count(*) FROM documents) AS a, (SELECT count(model_name)::DOUBLE / count(*) FROM relationship_evidence) AS s)""")
def a35(spark, d):
    # what the tables can show: claims with context, evidence scored both ways, documents with text, evidence with a named model
    have = {"claims": ("claims", "context"), "reproducibility": ("relationship_evidence", "ba"), "artifacts": ("documents", "text"), "statistics": ("relationship_evidence", "model_name")}
    parts = [table(spark, d, t).agg(F.count(c).alias("present"), F.count("*").alias("expected")).select(F.lit(k).alias("component"), "present", "expected") for k, (t, c) in have.items()]
    return E.coverage_index(parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]))


_FOLD = lambda x: f"CASE WHEN {x} IN ('SUPPORTS', 'REFINES', 'EQUIVALENT') THEN 'SUPPORTS' WHEN {x} = 'CONTRADICTS' THEN 'REFUTES' ELSE 'NOT ENOUGH INFO' END"
_THREE = f"(SELECT {_FOLD('gold')} AS g, {_FOLD('upper(predicted)')} AS p, predicted IS NULL AS none FROM {_MISS})"


@query("a43_three_way", f"""SELECT (SELECT count(*) FROM {_THREE}) AS n, (SELECT round(avg(CASE WHEN g = p THEN 1.0 ELSE 0.0 END::DOUBLE), 6) FROM {_THREE}) AS accuracy, (SELECT count(*) FROM {_THREE} WHERE none) AS n_abstained, round(avg(f1), 6) AS macro_f1 FROM (SELECT l, round(2.0::DOUBLE * tp / (gn + pn), 6) AS f1
 FROM (SELECT l, (SELECT count(*) FROM {_THREE} WHERE g = l AND p = l) AS tp, (SELECT count(*) FROM {_THREE} WHERE g = l) AS gn, (SELECT count(*) FROM {_THREE} WHERE p = l) AS pn FROM (SELECT DISTINCT g AS l FROM {_THREE})))""")
def a43(spark, d):
    label = F.upper(F.trim("label"))
    gold = table(spark, d, "pass1_relationships").where(label.isin("NEUTRAL", "SUPPORTS", "REFINES", "CONTRADICTS", "EQUIVALENT")).groupBy(F.col("id").alias("relationship_id")).agg(F.min(label).alias("gold"))
    texts = nodes_of(spark, d).select("claim_id", F.col("claim_text").alias("text"))
    r = R.apply_gates(R.resolve(flat(spark, d)), texts).select("relationship_id", F.upper("relation_type").alias("predicted"))
    return E.three_way(gold.join(r, "relationship_id", "left"))


@query("a47_claim_assessment", f"SELECT claim, n, round(s, 9) AS score, CASE WHEN n = 0 THEN 'unsupported' WHEN s >= 0.8 THEN 'well supported' WHEN s >= 0.5 THEN 'partly supported' WHEN s >= 0 THEN 'weakly supported' END AS level FROM (SELECT claim_id_a AS claim, count(e_ab) AS n, greatest(0.0, avg(e_ab) - 0.1::DOUBLE * count(*) FILTER (WHERE c_ab >= 0.8)) AS s FROM {sql.FLAT} GROUP BY 1)")
def a47(spark, d):
    return E.claim_assessment(flat(spark, d).select(F.col("claim_id_a").alias("claim"), F.col("e_ab").alias("score"), F.coalesce((F.col("c_ab") >= 0.8).cast("int"), F.lit(0)).alias("conflicts")))


_CRITERIA = {"context": "claims", "modality": "claims", "claim_id": "claims", "document_id": "claims"}


@query("a48_readiness", f"""SELECT met, partial, missing, round((met + 0.5::DOUBLE * partial) / n, 6) AS share, CASE WHEN met = n THEN 'ready' WHEN (met + 0.5) / n >= 0.8 AND (met + 0.5::DOUBLE * partial) / n >= 0.8 THEN 'nearly ready' WHEN (met + 0.5::DOUBLE * partial) / n >= 0.5 THEN 'in progress' ELSE 'not ready' END AS level
 FROM (SELECT count(*) AS n, count(*) FILTER (WHERE s >= 1) AS met, count(*) FILTER (WHERE s > 0 AND s < 1) AS partial, count(*) FILTER (WHERE s <= 0) AS missing FROM ({" UNION ALL ".join(f"SELECT count({c})::DOUBLE / count(*) AS s FROM {t}" for c, t in _CRITERIA.items())}))""")
def a48(spark, d):
    c = table(spark, d, "claims").agg(*[(F.count(x) / F.count("*")).alias(x) for x in _CRITERIA])
    return E.readiness(c.select(F.explode(F.array(*[F.struct(F.lit(x).alias("criterion"), F.col(x).alias("share")) for x in _CRITERIA])).alias("x")).select("x.*"))


@query("j09_gold_prediction", f"""SELECT g.id, g.gold, p.relation_type AS predicted FROM (SELECT id, min(upper(trim(label))) AS gold FROM pass1_relationships WHERE {VALID} GROUP BY 1) g JOIN (SELECT relationship_id, least(claim_id_a, claim_id_b) AS x, greatest(claim_id_a, claim_id_b) AS y FROM {sql.FLAT}) e ON e.relationship_id = g.id
 LEFT JOIN (SELECT least(claim_id_a, claim_id_b) AS x, greatest(claim_id_a, claim_id_b) AS y, min(relation_type) AS relation_type FROM {sql.EDGES} GROUP BY 1, 2) p USING (x, y)""")
def j09(spark, d):
    label = F.upper(F.trim("label"))
    gold = table(spark, d, "pass1_relationships").where(label.isin("NEUTRAL", "SUPPORTS", "REFINES", "CONTRADICTS", "EQUIVALENT")).groupBy("id").agg(F.min(label).alias("gold"))
    at = flat(spark, d).select(F.col("relationship_id").alias("id"), "claim_id_a", "claim_id_b")
    return E.gold_predictions(gold.join(at, "id"), typed(spark, d)).select("id", "gold", "predicted")


@query("j13_common_annotations", f"SELECT id, gold, predicted FROM {BOTH}")
def j13(spark, d):
    return both(spark, d).select("id", "gold", "predicted")
