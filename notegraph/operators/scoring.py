"""Reliability, importance and uncertainty of claims from eight signals, as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Signals in registry order, and their weights per profile; conflict_pressure counts against.
SIGNALS = ("evidence_strength", "evidence_independence", "source_diversity", "topology_strength", "hub_score", "bridge_score", "conflict_pressure", "temporal_stability")
PROFILES: dict[str, tuple[float, ...]] = {
    "balanced": (0.25, 0.15, 0.15, 0.10, 0.05, 0.05, 0.20, 0.05),
    "conservative": (0.35, 0.20, 0.10, 0.05, 0.02, 0.03, 0.25, 0.00),
    "research": (0.20, 0.25, 0.25, 0.05, 0.03, 0.02, 0.15, 0.05),
    "evidence_first": (0.45, 0.10, 0.10, 0.05, 0.03, 0.02, 0.20, 0.05),
}
EVIDENCE = ("evidence_strength", "evidence_independence", "source_diversity", "conflict_pressure", "temporal_stability")
IMPORTANCE = ("topology_strength", "hub_score", "bridge_score")
NEGATIVE = ("conflict_pressure",)
LABELS = ((80, "very_high"), (65, "high"), (45, "moderate"), (25, "low"))
ECHO_PENALTY, ECHO_THRESHOLD, PUBLISHER_WEIGHT, SATURATION = 0.30, 0.50, 0.50, 0.80
HOP_WEIGHTS = (1.0, 0.6, 0.3)


def label(index: Column) -> Column:
    """Calibration label of an index by the thresholds 80, 65, 45, 25; null is very_low."""
    out = F.when(F.lit(False), "very_low")
    for least, name in LABELS:
        out = out.when(index >= least, name)
    return out.otherwise("very_low")


def weights(profile: str, overrides: dict[str, float] | None = None) -> dict[str, float]:
    """Weights of a profile with overrides; they must sum to one and name the registered signals."""
    w = dict(zip(SIGNALS, PROFILES[profile], strict=True)) | (overrides or {})
    if set(w) != set(SIGNALS):
        raise ValueError(f"no signals {sorted(set(w) - set(SIGNALS))}")
    if abs(sum(w.values()) - 1) > 1e-3:
        raise ValueError(f"weights of {profile} do not sum to 1")
    return w


def family_weights(profile: str, family: tuple[str, ...]) -> dict[str, float]:
    """Weights of a family scaled to sum to one, negative signals counted; zero-weight signals are left out."""
    w = weights(profile)
    total = sum(w[s] for s in family)
    return {s: w[s] / total for s in family if w[s] > 0} if total > 0 else {}


def guard(value: Column) -> Column:
    """NaN, infinite and null values count 0, others are clamped to [0, 1]."""
    bad = value.isNull() | F.isnan(value) | (F.abs(value) == F.lit(float("inf")))
    return F.when(bad, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), value)))


def status(value: Column) -> Column:
    bad = value.isNull() | F.isnan(value) | (F.abs(value) == F.lit(float("inf")))
    return F.when(bad, "unavailable").otherwise("measured")


# signals over a node table; see `signals` for its columns


def evidence_strength(strength: Column, confidence: Column, most: Column) -> Column:
    return guard(0.7 * F.log1p(strength) / F.log1p(F.greatest(F.lit(1.0), most.cast("double"))) + 0.3 * confidence)


def evidence_independence(documents: Column, publishers: Column, n: Column) -> Column:
    """Blend of distinct sources and publishers per supporter, cut below one half; null, unavailable, without supporters."""
    blend = (1 - PUBLISHER_WEIGHT) * documents / n + PUBLISHER_WEIGHT * publishers / n
    return F.when(n > 0, guard(F.when(blend < ECHO_THRESHOLD, blend * (1 - ECHO_PENALTY)).otherwise(blend)))


def source_diversity(sources: Column, most: Column) -> Column:
    return guard(F.log1p(sources) / F.log1p(F.greatest(F.lit(1.0), most.cast("double"))))


def conflict_pressure(n: Column, average_confidence: Column, most: Column) -> Column:
    count = F.log1p(n) / F.log1p(F.greatest(F.lit(1.0), most.cast("double")))
    saturated = F.when(count < SATURATION, count / SATURATION).otherwise(1.0)
    return F.when(n == 0, 0.0).otherwise(guard(saturated * (0.7 + 0.3 * average_confidence)))


def temporal_stability(temporal_status: Column, confidence: Column) -> Column:
    bonus = F.least(F.lit(1.0), F.lit(0.65) + 0.1 * F.when(confidence > 0, confidence).otherwise(0.5))
    return F.when(temporal_status == "evolution", bonus).when(temporal_status == "static_partition", 0.5).when(temporal_status == "unresolved", 0.4)


class SignalRegistry:
    """Signals by name, each a function of the node row's columns; read in the order of priority, then name."""

    def __init__(self) -> None:
        self.held: dict[str, tuple[int, Callable[[], Column]]] = {}

    def register(self, name: str, column: Callable[[], Column], priority: int = 100) -> None:
        """Adds a signal; a name can be taken again only by the same function."""
        if name in self.held and self.held[name][1] is not column:
            raise ValueError(f"signal {name} is registered with another function")
        self.held.setdefault(name, (priority, column))

    def deregister(self, name: str) -> None:
        self.held.pop(name, None)

    def ordered(self) -> list[str]:
        return sorted(self.held, key=lambda n: (self.held[n][0], n))

    def columns(self) -> list[Column]:
        return [self.held[n][1]().alias(n) for n in self.ordered()]


def signals(nodes: DataFrame, extra: SignalRegistry | None = None) -> DataFrame:
    """claim_id, the eight raw signals and those of `extra`, which are kept beside the index; null is unavailable.

    nodes: claim_id, support_count, discounted_strength, discounted_confidence, n_sources, n_publishers,
    n_groups, contradictions, contradiction_confidence, centrality, is_hub, is_bridge, temporal_status,
    temporal_confidence.  Maxima over all nodes are one aggregate row, broadcast.
    """
    most = nodes.agg(
        F.greatest(F.lit(1), F.coalesce(F.max("support_count"), F.lit(0))).alias("most_support"), F.greatest(F.lit(1), F.coalesce(F.max("n_sources"), F.lit(0))).alias("most_sources"),
        F.greatest(F.lit(1), F.coalesce(F.max("contradictions"), F.lit(0))).alias("most_conflicts"),
    )
    rows = nodes.crossJoin(F.broadcast(most))  # one row
    c = F.col
    return rows.select(
        "claim_id",
        F.when(c("support_count").isNull(), F.lit(None).cast("double")).when(c("support_count") == 0, 0.0).otherwise(evidence_strength(c("discounted_strength"), c("discounted_confidence"), c("most_support"))).alias("evidence_strength"),
        F.when(c("support_count").isNull(), F.lit(None).cast("double")).otherwise(evidence_independence(c("n_sources"), c("n_publishers"), c("n_groups"))).alias("evidence_independence"),
        F.when(c("support_count").isNull(), F.lit(None).cast("double")).otherwise(source_diversity(c("n_sources"), c("most_sources"))).alias("source_diversity"),
        guard(c("centrality")).alias("topology_strength"), c("is_hub").cast("double").alias("hub_score"), c("is_bridge").cast("double").alias("bridge_score"),
        conflict_pressure(c("contradictions"), c("contradiction_confidence"), c("most_conflicts")).alias("conflict_pressure"),
        temporal_stability(c("temporal_status"), c("temporal_confidence")).alias("temporal_stability"), *(extra.columns() if extra else []),
    )


def _fused(profile: str, family: tuple[str, ...]) -> tuple[Column, Column]:
    """(sum of contributions, array of component structs ordered by absolute contribution)."""
    w = family_weights(profile, family)
    parts, total = [], F.lit(0.0)
    for s, x in w.items():
        value = guard(F.col(s))
        if s == "evidence_strength" and "evidence_independence" in w:
            value = F.when(guard(F.col("evidence_independence")) < ECHO_THRESHOLD, value * (1 - ECHO_PENALTY)).otherwise(value)
        contribution = value * F.lit((-100.0 if s in NEGATIVE else 100.0) * x)
        total = total + contribution
        parts.append(F.struct(F.lit(s).alias("signal"), value.alias("value"), F.lit(x).alias("weight"), contribution.alias("contribution")))
    order = lambda a, b: F.when(F.abs(a["contribution"]) > F.abs(b["contribution"]), -1).when(F.abs(a["contribution"]) < F.abs(b["contribution"]), 1).when(a["signal"] < b["signal"], -1).otherwise(1)
    return total, F.array_sort(F.array(*parts), order)


def capped(total: Column, strength: Column, conflict: Column) -> Column:
    """At most 60 without evidence (strength below .10), at most 40 under full conflict (.90 or more)."""
    x = F.when(strength < 0.10, F.least(total, F.lit(60.0))).otherwise(total)
    return F.when(conflict >= 0.90, F.least(x, F.lit(40.0))).otherwise(x)


def score(raw: DataFrame, profile: str = "balanced") -> DataFrame:
    """raw signals with index, importance, uncertainty, completeness, label, components and explanation columns."""
    evidence, components = _fused(profile, EVIDENCE)
    importance, importance_components = _fused(profile, IMPORTANCE)
    clamp = lambda x: F.least(F.lit(100.0), F.greatest(F.lit(0.0), x))
    g = {s: guard(F.col(s)) for s in SIGNALS}
    completeness = sum((F.when(status(F.col(s)) == "measured", 1.0).otherwise(0.0) for s in SIGNALS[1:]), F.when(status(F.col(SIGNALS[0])) == "measured", 1.0).otherwise(0.0)) / len(SIGNALS)
    uncertainty = 100 * (0.35 * (1 - completeness) + 0.20 * (1 - g["source_diversity"]) + 0.20 * (1 - g["evidence_independence"]) + 0.25 * g["conflict_pressure"])
    out = raw.withColumns({
        "reliability_index": clamp(capped(evidence, g["evidence_strength"], g["conflict_pressure"])), "importance_index": clamp(importance), "evidence_completeness": completeness,
        "uncertainty_score": clamp(uncertainty), "components": components, "importance_components": importance_components, "policy_version": F.lit(profile),
        "signal_statuses": F.map_from_arrays(F.array(*[F.lit(s) for s in SIGNALS]), F.array(*[status(F.col(s)) for s in SIGNALS])),
    })
    return out.withColumn("calibration_label", label(F.col("reliability_index")))


def explain(scored: DataFrame) -> DataFrame:
    """scored with summary, dominant and limiting signal, up to three strengths and weaknesses, and recommendations."""
    up = F.filter("components", lambda c: c["contribution"] > 0)
    down = F.filter("components", lambda c: c["contribution"] < 0)
    show = lambda xs: F.slice(F.transform(xs, lambda c: F.struct(c["signal"].alias("signal"), F.round(c["contribution"], 2).alias("contribution"))), 1, 3)
    first = lambda xs: F.when(F.size(xs) > 0, F.element_at(xs, 1)["signal"])
    index = F.round("reliability_index", 1).cast("string")
    words = lambda c: F.regexp_replace(c, "_", " ")
    summary = F.concat(
        F.lit("Index "), index, F.lit(" of 100 ("), words(F.col("calibration_label")), F.lit(")"),
        F.coalesce(F.concat(F.lit("; raised most by "), words(first(up))), F.lit("; raised by no signal")), F.coalesce(F.concat(F.lit(", lowered most by "), words(first(down))), F.lit("")), F.lit("."),
    )
    # a hint per evidence signal that gives less than a fifth of what it could give or takes more than half of what it could take
    hints = {
        "evidence_strength": "few or weak supporting claims: look for more", "evidence_independence": "supporters share sources or publishers: look for others", "source_diversity": "support comes from few sources: widen them",
        "conflict_pressure": "strong contradictions: read the contradicting claims", "temporal_stability": "the claim changes over time: watch its dates",
    }
    share = lambda c: c["contribution"] / (F.lit(100.0) * c["weight"])
    poor = lambda c: F.when(c["signal"].isin(*NEGATIVE), share(c) < -0.5).otherwise(share(c) < 0.2)
    hint = F.create_map(*[F.lit(x) for pair in hints.items() for x in pair])
    recs = F.array_sort(F.transform(F.filter("components", poor), lambda c: F.element_at(hint, c["signal"])))
    return scored.withColumns({
        "summary": summary, "dominant_signal": F.coalesce(first(up), F.lit("none")), "limiting_signal": F.coalesce(first(down), F.lit("none")), "strengths": show(up), "weaknesses": show(down),
        "recommendations": recs,
    })


#: Columns of the explanation levels.
EXPLAIN_LEVELS = {
    0: ("claim_id", "reliability_index", "calibration_label", "uncertainty_score", "evidence_completeness"),
    1: ("summary", "dominant_signal", "limiting_signal"),
    2: ("components", *SIGNALS, "signal_statuses", "strengths", "weaknesses"),
    3: ("recommendations", "importance_index", "importance_components", "policy_version"),
}


def explain_level(explained: DataFrame, level: int) -> DataFrame:
    if level not in EXPLAIN_LEVELS:
        raise ValueError("level must be 0 to 3")
    return explained.select(*[c for i in range(level + 1) for c in EXPLAIN_LEVELS[i]])


def reconstruct(scored: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """claim_id, stored, rebuilt, exact: the index rebuilt from the stored components."""
    total = F.aggregate("components", F.lit(0.0), lambda a, c: a + c["contribution"])
    rebuilt = F.least(F.lit(100.0), F.greatest(F.lit(0.0), capped(total, guard(F.col("evidence_strength")), guard(F.col("conflict_pressure")))))
    return scored.select("claim_id", F.col("reliability_index").alias("stored"), rebuilt.alias("rebuilt"), (F.abs(rebuilt - F.col("reliability_index")) <= tolerance).alias("exact"))


def ablation(raw: DataFrame, profile: str = "balanced") -> DataFrame:
    """signal, mean_shift, mean_abs_delta, correlation: leaving out one evidence signal at a time, weights not rescaled."""
    w = family_weights(profile, EVIDENCE)

    def fused(without: str | None) -> Column:
        total = F.lit(0.0)
        for s, x in w.items():
            if s != without:
                value = guard(F.col(s))
                if s == "evidence_strength" and without != "evidence_independence":
                    value = F.when(guard(F.col("evidence_independence")) < ECHO_THRESHOLD, value * (1 - ECHO_PENALTY)).otherwise(value)
                total = total + value * F.lit((-100.0 if s in NEGATIVE else 100.0) * x)
        return F.least(F.lit(100.0), F.greatest(F.lit(0.0), total))

    rows = raw.select("claim_id", fused(None).alias("base"), F.explode(F.array(*[F.struct(F.lit(s).alias("signal"), fused(s).alias("value")) for s in w])).alias("x"))
    r = rows.select("base", "x.signal", "x.value").groupBy("signal").agg(
        F.avg(F.col("value") - F.col("base")).alias("mean_shift"), F.avg(F.abs(F.col("value") - F.col("base"))).alias("mean_abs_delta"),
        F.try_divide(F.covar_pop("base", "value"), F.stddev_pop("base") * F.stddev_pop("value")).alias("r"), F.var_pop("base").alias("vb"), F.var_pop("value").alias("vv"),
    )
    return r.select("signal", F.round("mean_shift", 6).alias("mean_shift"), F.round("mean_abs_delta", 6).alias("mean_abs_delta"), F.when((F.col("vb") <= 1e-12) & (F.col("vv") <= 1e-12), 1.0).when((F.col("vb") <= 1e-12) | (F.col("vv") <= 1e-12), 0.0).otherwise(F.round("r", 6)).alias("correlation"))


def diagnostic(raw: DataFrame) -> DataFrame:
    """signal, availability, mean, variance, nonzero_fraction."""
    rows = raw.select(F.explode(F.array(*[F.struct(F.lit(s).alias("signal"), F.col(s).cast("double").alias("v")) for s in SIGNALS])).alias("x")).select("x.signal", "x.v")
    return rows.groupBy("signal").agg(
        F.round(F.avg((status(F.col("v")) == "measured").cast("double")), 6).alias("availability"), F.round(F.avg(guard(F.col("v"))), 6).alias("mean"),
        F.round(F.var_pop(guard(F.col("v"))), 6).alias("variance"), F.round(F.avg((guard(F.col("v")) > 0).cast("double")), 6).alias("nonzero_fraction"),
    )
