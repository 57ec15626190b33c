"""Typed relations from pair scores: resolver, confidence, gates, validation, conflicts, heuristics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notegraph.functions import lexicon

#: Resolver rules in their usual order.
PRIORITY = ("contradicts", "equivalent", "supports", "refines", "neutral", "unknown")


@dataclass(frozen=True)
class ResolverPolicy:
    nli_threshold: float = 0.80
    neutrality_threshold: float = 0.60
    contradiction_margin: float = 0.0
    entailment_margin: float = 0.0
    priority: tuple[str, ...] = PRIORITY

    def __post_init__(self):
        if sorted(self.priority) != sorted(PRIORITY):
            raise ValueError("priority must be a permutation of the six rules")
        for v in (self.nli_threshold, self.neutrality_threshold):
            if not 0.0 <= v <= 1.0:
                raise ValueError("thresholds lie in [0, 1]")


def flat_evidence(evidence: DataFrame) -> DataFrame:
    """Distinct evidence rows with the scores of both directions as columns e_ab, n_ab, c_ab, e_ba, n_ba, c_ba."""
    return evidence.select(
        "relationship_id", "claim_id_a", "claim_id_b", "cosine_similarity", "candidate_rank",
        *[F.col(f"{d}.{name}_score").alias(f"{name[0]}_{d}") for d in ("ab", "ba") for name in ("entailment", "neutral", "contradiction")],
        "conf_ab", "conf_ba", "model_name",
    ).distinct()


def raw_confidence(e: Column, n: Column, c: Column) -> Column:
    return F.greatest(e, n, c)


def predicted_label(e: Column, n: Column, c: Column) -> Column:
    """The label of the greatest score; contradiction, then entailment win ties."""
    top = F.greatest(e, n, c)
    return F.when(c == top, "contradiction").when(e == top, "entailment").when(n == top, "neutral")


def resolve(flat: DataFrame, policy: ResolverPolicy = ResolverPolicy()) -> DataFrame:
    """flat evidence with relation_type and direction.

    Without b-to-a scores the rules read the a-to-b scores alone.  Rows without a-to-b scores are unknown.
    """
    p = policy
    one = F.col("e_ba").isNull()
    c = F.when(one, F.col("c_ab")).otherwise((F.col("c_ab") + F.col("c_ba")) / 2)
    n = F.when(one, F.col("n_ab")).otherwise((F.col("n_ab") + F.col("n_ba")) / 2)
    e = F.when(one, F.col("e_ab")).otherwise(F.greatest("e_ab", "e_ba"))

    def entails(d: str) -> Column:
        x = F.col(f"e_{d}")
        test = (x >= p.nli_threshold) & (x - F.col(f"c_{d}") >= p.entailment_margin) & (x - F.col(f"n_{d}") >= p.entailment_margin)
        return F.coalesce(test, F.lit(False))

    ab, ba = entails("ab"), entails("ba")
    contra = F.coalesce((c >= p.nli_threshold) & (c - e >= p.contradiction_margin) & (c - n >= p.contradiction_margin), F.lit(False))
    neutral = F.coalesce(F.greatest(n, F.col("n_ab"), F.col("n_ba")) >= p.neutrality_threshold, F.lit(False))
    tests = {"contradicts": contra, "equivalent": ab & ba, "supports": ab != ba, "refines": F.lit(False), "neutral": neutral, "unknown": F.lit(True)}
    ladder = F.when(F.lit(False), "unknown")
    for rule in p.priority:
        ladder = ladder.when(tests[rule], rule)
    out = flat.withColumn("relation_type", ladder)
    return out.withColumn("direction", F.when(F.col("relation_type") == "supports", F.when(ab, "a_to_b").otherwise("b_to_a")).otherwise("symmetric"))


def decision_confidence() -> Column:
    """Confidence of the decision: mean, weaker or chosen direction by type; a-to-b where b-to-a is missing."""
    a, b, t = F.col("conf_ab"), F.col("conf_ba"), F.col("relation_type")
    return (
        F.when(b.isNull(), a).when(t == "equivalent", F.least(a, b))
        .when(t.isin("supports", "refines"), F.when(F.col("direction") == "a_to_b", a).otherwise(b)).otherwise((a + b) / 2)
    )


def apply_gates(resolved: DataFrame, texts: DataFrame, relatedness: float = 0.03, margin: float = 3.0) -> DataFrame:
    """Contradictions of unrelated texts become unknown; supports by a clearly more specific claim become refines.

    texts: (claim_id, text), one row per claim.  A missing text counts as empty, so it is related to nothing.
    """
    a = texts.select(F.col("claim_id").alias("claim_id_a"), F.col("text").alias("text_a"))
    b = texts.select(F.col("claim_id").alias("claim_id_b"), F.col("text").alias("text_b"))
    joined = resolved.join(a, "claim_id_a", "left").join(b, "claim_id_b", "left")
    related = lexicon.relatedness(F.col("text_a"), F.col("text_b"))
    forward = lexicon.specificity(F.col("text_a")) - lexicon.specificity(F.col("text_b"))
    delta = F.when(F.col("direction") == "a_to_b", forward).otherwise(-forward)
    t = F.col("relation_type")
    return joined.withColumn("relation_type", F.when((t == "contradicts") & (related < relatedness), "unknown").when((t == "supports") & (delta >= margin), "refines").otherwise(t))


def rejection_reason(threshold: float = 0.80, least: float = 0.50, skip_unknown: bool = True, skip_neutral: bool = True) -> Column:
    """Why a resolved row is dropped, null if it is valid; checks in order."""
    t = F.col("relation_type")
    both = lambda d: F.coalesce((F.col(f"e_{d}") >= threshold) & (F.col(f"c_{d}") >= threshold), F.lit(False))
    wrong = (t.isin("contradicts", "equivalent") & (F.col("direction") != "symmetric")) | (t.isin("supports", "refines") & (F.col("direction") == "symmetric"))
    ladder = F.when(F.col("decision_confidence") < least, "confidence_too_low")
    if skip_unknown:
        ladder = ladder.when(t == "unknown", "unknown_relationship")
    if skip_neutral:
        ladder = ladder.when(t == "neutral", "neutral_relationship")
    return ladder.when(both("ab") | both("ba"), "contradictory_evidence").when(wrong, "direction_invariant")


def relation_id(schema_version: str = "7.0") -> Column:
    return F.substring(F.sha2(F.concat_ws(":", "claim_id_a", "claim_id_b", "relation_type", F.lit(schema_version)), 256), 1, 16)


def relations(evidence: DataFrame, texts: DataFrame | None = None, policy: ResolverPolicy = ResolverPolicy(), least: float = 0.50, relatedness: float = 0.03) -> DataFrame:
    """Valid typed relations of an evidence table: resolve, gates where texts are given, confidence, validation, id."""
    out = resolve(flat_evidence(evidence), policy)
    if texts is not None:
        out = apply_gates(out, texts, relatedness)
    out = out.withColumn("decision_confidence", decision_confidence()).withColumn("rejection_reason", rejection_reason(policy.nli_threshold, least))
    return out.where("rejection_reason is null").withColumn("edge_id", relation_id())


def resolve_conflicts(relations: DataFrame, policy: str = "highest_confidence") -> DataFrame:
    """One relation per unordered pair; among several the policy decides, ties by edge id.

    latest_wins takes the greatest run_id, highest_confidence the greatest decision confidence,
    most_specific the least candidate rank; conservative drops pairs of more than one type.
    """
    keyed = relations.withColumn("x", F.least("claim_id_a", "claim_id_b")).withColumn("y", F.greatest("claim_id_a", "claim_id_b"))
    orders = {
        "latest_wins": [F.col("run_id").desc()] if "run_id" in relations.columns else [],
        "highest_confidence": [F.col("decision_confidence").desc()],
        "most_specific": [F.col("candidate_rank").asc()],
        "conservative": [F.col("decision_confidence").desc()],
    }
    if policy not in orders:
        raise ValueError(f"unknown conflict policy {policy}")
    w = Window.partitionBy("x", "y")
    out = keyed.withColumn("o", F.row_number().over(w.orderBy(*orders[policy], "edge_id")))
    if policy == "conservative":
        out = out.withColumn("lo", F.min("relation_type").over(w)).withColumn("hi", F.max("relation_type").over(w)).where("lo = hi").drop("lo", "hi")
    return out.where("o = 1").drop("x", "y", "o")


def heuristic_type(text_a: Column, text_b: Column, similarity: Column, support: float, candidate: float) -> Column:
    """Baseline: one-sided negation cue at candidate similarity contradicts, high similarity supports, else neutral."""
    differ = lexicon.has_negation_cue(text_a) != lexicon.has_negation_cue(text_b)
    return F.when(differ & (similarity >= candidate), "CONTRADICTS").when(similarity >= support, "SUPPORTS").otherwise("NEUTRAL")


def temperature_confidence(e: Column, n: Column, c: Column, temperature: float) -> Column:
    """Greatest probability after the softmax of the log scores divided by the temperature."""
    logs = [F.log(F.greatest(x, F.lit(1e-12))) / temperature for x in (e, n, c)]
    top = F.greatest(*logs)
    total = sum((F.exp(x - top) for x in logs[1:]), F.exp(logs[0] - top))
    return F.lit(1.0) / total


def percentile_confidence(raw: Column, reference: list[float]) -> Column:
    """Share of the reference values below the raw confidence."""
    ref = F.array(*[F.lit(float(x)) for x in reference])
    return F.size(F.filter(ref, lambda x: x < raw)) / F.lit(float(max(1, len(reference))))


def isotonic_confidence(raw: Column, knots: list[tuple[float, float]]) -> Column:
    """Piecewise linear map through the knots, constant outside."""
    knots = sorted(knots)
    out = F.when(raw <= knots[0][0], F.lit(knots[0][1]))
    for (x0, y0), (x1, y1) in zip(knots, knots[1:]):
        out = out.when(raw <= x1, F.lit(y0) + (raw - F.lit(x0)) * F.lit((y1 - y0) / (x1 - x0) if x1 > x0 else 0.0))
    return out.otherwise(F.lit(knots[-1][1]))
