"""Queries of the scoring expressions and of the whole scored graph."""

from pyspark.sql import functions as F

from notegraph.operators import scoring as S
from notegraph.plans import base, sql
from notegraph.plans.registry import query

SIGNALS = sql.SIGNALS


EXPLANATION = ("supporting_ids", "explanation_summary", "dominant_signal", "limiting_signal", "component_scores", "recommendations", "audit_run_id")


def signals_of(spark, d, relatedness=base.RELATEDNESS):
    return base.scored_graph(spark, d, relatedness).scored.select("claim_id", *S.SIGNALS)


def signal_query(name, sql_text=None):
    """Registers f(spark, d, signals) over the eight signals of the scored graph."""

    def add(f):
        query(name, sql_text)(lambda spark, d: f(spark, d, signals_of(spark, d)))
        return f

    return add


def scored_sql(profile):
    places = ", ".join(f"round({c}, 6) AS {c}" for c in ("reliability_index", "importance_index", "evidence_completeness", "uncertainty_score"))
    return f"(SELECT claim_id, {places}, calibration_label FROM {sql.scored(profile)})"


_SIX = ", ".join(f"round({s}, 6) AS {s}" for s in S.SIGNALS)


@signal_query("k01_signals", f"SELECT claim_id, {_SIX} FROM {sql.SIGNALS}")
def k01(spark, d, signals):
    return base.rounded6(signals)


@query("k01_signals_ungated", sql.ungated(f"SELECT claim_id, {_SIX} FROM {sql.SIGNALS}"))
def k01u(spark, d):
    return base.rounded6(signals_of(spark, d, 0.0))


def _profile(profile):
    @signal_query(f"k11_fusion_{profile}", f"SELECT * FROM {scored_sql(profile)}")
    def run(spark, d, signals):
        out = S.score(signals, profile)
        return out.select("claim_id", *[F.round(c, 6).alias(c) for c in ("reliability_index", "importance_index", "evidence_completeness", "uncertainty_score")], "calibration_label")


for _p in S.PROFILES:
    _profile(_p)


@signal_query("k08_signal_status", f"SELECT claim_id, CASE WHEN conflict_pressure IS NULL THEN 'unavailable' ELSE 'measured' END AS conflict_status, round({sql.g('conflict_pressure')}, 6) AS conflict_value, CASE WHEN evidence_independence IS NULL THEN 'unavailable' ELSE 'measured' END AS independence_status FROM {SIGNALS}")
def k08(spark, d, signals):
    return signals.select("claim_id", S.status(F.col("conflict_pressure")).alias("conflict_status"), F.round(S.guard(F.col("conflict_pressure")), 6).alias("conflict_value"), S.status(F.col("evidence_independence")).alias("independence_status"))


@signal_query("k14_label_counts", f"SELECT calibration_label, count(*) AS n FROM {scored_sql('research')} GROUP BY 1")
def k14(spark, d, signals):
    return S.score(signals, "research").groupBy("calibration_label").agg(F.count("*").alias("n"))


@query("k15_explanations")
def k15(spark, d):
    return S.explain_level(base.scored_graph(spark, d).scored, 3).drop("signal_statuses")


@signal_query("f12_explain_summary", f"SELECT claim_id, reliability_index, calibration_label, uncertainty_score, evidence_completeness FROM {scored_sql('balanced')}")
def f12(spark, d, signals):
    out = S.explain_level(S.explain(S.score(signals)), 0)
    return out.withColumns({c: F.round(c, 6) for c in ("reliability_index", "uncertainty_score", "evidence_completeness")})


@signal_query("k18_reconstruction", f"SELECT claim_id, round(reliability_index, 2) AS stored, round(least(100.0, greatest(0.0, CASE WHEN {sql.g('conflict_pressure')} >= 0.9 THEN least(y, 40.0) ELSE y END)), 2) AS rebuilt, true AS exact FROM (SELECT *, CASE WHEN {sql.g('evidence_strength')} < 0.1 THEN least({sql.total('balanced', S.EVIDENCE)}, 60.0) ELSE {sql.total('balanced', S.EVIDENCE)} END AS y FROM {sql.scored()})")
def k18(spark, d, signals):
    return S.reconstruct(S.score(signals)).select("claim_id", F.round("stored", 2).alias("stored"), F.round("rebuilt", 2).alias("rebuilt"), "exact")


ABLATION = " UNION ALL ".join(f"SELECT '{s}' AS signal, least(100.0, greatest(0.0, {sql.total('balanced', S.EVIDENCE)})) AS b, least(100.0, greatest(0.0, {sql.total('balanced', S.EVIDENCE, s)})) AS v FROM {SIGNALS}" for s in S.family_weights("balanced", S.EVIDENCE))


@signal_query("a27_ablation", f"SELECT signal, round(avg(v - b), 6) AS mean_shift, round(avg(abs(v - b)), 6) AS mean_abs_delta, round(corr(b, v), 6) AS correlation FROM ({ABLATION}) GROUP BY 1")
def a27(spark, d, signals):
    return S.ablation(signals)


DIAG = " UNION ALL ".join(f"SELECT '{s}' AS signal, {s} AS x, {sql.g(s)} AS v FROM {SIGNALS}" for s in S.SIGNALS)


@signal_query("a28_diagnostic", f"SELECT signal, round(avg(CASE WHEN x IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE), 6) AS availability, round(avg(v), 6) AS mean, round(var_pop(v), 6) AS variance, round(avg(CASE WHEN v > 0 THEN 1.0 ELSE 0.0 END::DOUBLE), 6) AS nonzero_fraction FROM ({DIAG}) GROUP BY 1")
def a28(spark, d, signals):
    return S.diagnostic(signals)


@query("k00_scored_graph", f"SELECT * FROM {sql.RECORDS}")
def k00(spark, d):
    return base.claim_records(spark, d).drop(*EXPLANATION)


@query("k00_scored_graph_ungated", sql.ungated(f"SELECT * FROM {sql.RECORDS}"))
def k00u(spark, d):
    return base.claim_records(spark, d, 0.0).drop(*EXPLANATION)
