"""Evaluation analytics: agreement, precision and recall, calibration, risk and coverage, bootstrap, splits, certification."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notegraph.lineage import Scratch
from notegraph.operators.ranking import BEFORE, IN_GROUP, SLICE, first_of_groups, sliced


def prf(rows: DataFrame, gold: str = "gold", predicted: str = "predicted") -> DataFrame:
    """label, tp, fp, fn, support, precision, recall, f1 of every label; zero where a divisor is zero."""
    r = rows.where(F.col(gold).isNotNull())
    g = r.groupBy(F.col(gold).alias("label")).agg(F.count("*").alias("support"), F.count_if(F.col(gold).eqNullSafe(F.col(predicted))).alias("tp"))
    p = r.where(F.col(predicted).isNotNull()).groupBy(F.col(predicted).alias("label")).agg(F.count("*").alias("said"))
    x = g.join(p, "label", "full").fillna(0).withColumns({"fp": F.col("said") - F.col("tp"), "fn": F.col("support") - F.col("tp")})
    precision, recall = F.when(F.col("said") > 0, F.col("tp") / F.col("said")).otherwise(0.0), F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)
    f1 = F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)
    return x.select("label", "tp", "fp", "fn", "support", F.round(precision, 6).alias("precision"), F.round(recall, 6).alias("recall"), F.round(f1, 6).alias("f1"))


def averages(per_label: DataFrame) -> DataFrame:
    """One row: macro-F1 over labels with support, micro-F1."""
    s = per_label.agg(F.avg(F.when(F.col("support") > 0, F.col("f1"))).alias("m"), F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    return s.select(F.round("m", 6).alias("macro_f1"), F.round(2 * F.col("tp") / F.greatest(F.lit(1), 2 * F.col("tp") + F.col("fp") + F.col("fn")), 6).alias("micro_f1"))


def confusion(rows: DataFrame, gold: str = "gold", predicted: str = "predicted") -> DataFrame:
    return rows.groupBy(gold, predicted).agg(F.count("*").alias("n"))


def kappa(rows: DataFrame, a: str, b: str) -> DataFrame:
    """One row: n, observed, expected, kappa of two categorical columns; 1 where both agree and chance would too."""
    n = rows.agg(F.count("*").alias("n"), F.avg((F.col(a) == F.col(b)).cast("double")).alias("po"))
    ca, cb = rows.groupBy(F.col(a).alias("l")).agg(F.count("*").alias("x")), rows.groupBy(F.col(b).alias("l")).agg(F.count("*").alias("y"))
    pe = ca.join(cb, "l").agg(F.coalesce(F.sum(F.col("x") * F.col("y")), F.lit(0)).alias("xy"))
    j = n.crossJoin(pe).withColumn("pe", F.col("xy") / (F.col("n") * F.col("n")))  # one row each
    return j.select("n", F.round("po", 6).alias("observed"), F.round("pe", 6).alias("expected"), F.round(F.when(F.col("pe") < 1, (F.col("po") - F.col("pe")) / (1 - F.col("pe"))).otherwise(1.0), 6).alias("kappa"))


def reliability_diagram(rows: DataFrame, confidence: str, correct: str, bins: int = 10) -> DataFrame:
    """bin, n, mean_confidence, accuracy of the non-empty bins; the last bin is closed."""
    at = F.least(F.floor(F.col(confidence) * bins), F.lit(bins - 1)).cast("int")
    return rows.groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg(confidence), 6).alias("mean_confidence"), F.round(F.avg(F.col(correct).cast("double")), 6).alias("accuracy"))


def calibration(rows: DataFrame, confidence: str, correct: str, bins: int = 10) -> DataFrame:
    """One row: expected calibration error, Brier score and negative log-likelihood."""
    at = F.least(F.floor(F.col(confidence) * bins), F.lit(bins - 1)).cast("int")
    y, c = F.col(correct).cast("double"), F.col(confidence)
    per = rows.groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.avg(c).alias("mc"), F.avg(y).alias("ma"), F.sum((c - y) * (c - y)).alias("b"), F.sum(-(y * F.log(F.greatest(c, F.lit(1e-12))) + (1 - y) * F.log(F.greatest(1 - c, F.lit(1e-12))))).alias("l"))
    n = F.sum("n")
    return per.agg(F.round(F.sum(F.col("n") * F.abs(F.col("mc") - F.col("ma"))) / n, 6).alias("ece"), F.round(F.sum("b") / n, 6).alias("brier"), F.round(F.sum("l") / n, 6).alias("nll"))


def temperature_grid(rows: DataFrame, e: str, n: str, c: str, correct: str, step: float = 0.02, least: float = 0.05, most: float = 5.0) -> DataFrame:
    """temperature, nll over the whole grid: every row meets every temperature in a map-side aggregate."""
    k = int((most - least) / step + 1e-9) + 1
    grid = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.round(F.lit(least) + i * F.lit(step), 6))
    logs = [F.log(F.greatest(F.col(x), F.lit(1e-12))) for x in (e, n, c)]
    r = rows.select(*[x.alias(f"l{i}") for i, x in enumerate(logs)], F.col(correct).cast("double").alias("y"), F.explode(grid).alias("temperature"))
    t = F.col("temperature")
    parts = [F.col(f"l{i}") / t for i in range(3)]
    top = F.greatest(*parts)
    conf = 1 / sum((F.exp(p - top) for p in parts[1:]), F.exp(parts[0] - top))
    conf = F.least(F.greatest(conf, F.lit(1e-12)), F.lit(1 - 1e-12))
    return r.groupBy("temperature").agg(F.round(F.avg(-(F.col("y") * F.log(conf) + (1 - F.col("y")) * F.log(1 - conf))), 6).alias("nll"))


def fit_temperature(grid: DataFrame) -> DataFrame:
    """One row: the temperature of least nll, the lower on ties."""
    return grid.orderBy("nll", "temperature").limit(1)


def risk_coverage(rows: DataFrame, confidence: str, correct: str, key: str, points: int = 20) -> DataFrame:
    """point, coverage, risk: error rate among the max(1, round(i n / points)) most confident rows; ties by key.

    The rows are cut into ranges of (confidence, key); of the ranges in which a point falls the
    rows are ranked, of the others only counts are used.
    """
    scratch = Scratch(rows.sparkSession, "risk")
    order = [F.col("c").desc(), F.col("k").asc()]
    r = rows.select(F.col(confidence).alias("c"), F.col(key).alias("k"), (~F.col(correct)).cast("int").alias("e"))
    placed, counts = sliced(r, [], order, scratch, {"err_before": F.col("e")})
    at = F.transform(F.sequence(F.lit(1), F.lit(points)), lambda i: F.struct(i.alias("point"), F.greatest(F.lit(1), F.bround(i * F.col(IN_GROUP).cast("double") / points)).cast("bigint").alias("r")))
    hit = counts.select(SLICE, BEFORE, IN_GROUP, "n", "err_before", F.explode(at).alias("w")).where((F.col("w.r") > F.col(BEFORE)) & (F.col("w.r") <= F.col(BEFORE) + F.col("n")))
    hit = scratch.table(hit.select(SLICE, BEFORE, IN_GROUP, "err_before", "w.point", "w.r"))
    w = Window.partitionBy(SLICE).orderBy(*order)
    inside = placed.join(F.broadcast(hit.select(SLICE).distinct()), SLICE, "left_semi")  # at most `points` slices
    run = inside.select(SLICE, F.row_number().over(w).alias("o"), F.sum("e").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("err"))
    found = run.join(hit, SLICE).where(F.col("o") + F.col(BEFORE) == F.col("r"))
    return found.select("point", F.round(F.col("r") / F.col(IN_GROUP), 6).alias("coverage"), F.round((F.col("err") + F.col("err_before")) / F.col("r"), 6).alias("risk"))


def aurc(curve: DataFrame) -> DataFrame:
    """One row: area under the curve by the trapezoid rule over the width it covers."""
    w = Window.orderBy("coverage", "point")
    x = curve.withColumn("dx", F.col("coverage") - F.lag("coverage").over(w)).withColumn("y", (F.col("risk") + F.lag("risk").over(w)) / 2)
    return x.agg(F.round(F.sum(F.col("dx") * F.col("y")), 6).alias("aurc"))


def bootstrap(rows: DataFrame, value: str, group: str | None = None, level: float = 0.95, resamples: int = 2000, seed: int = 42) -> DataFrame:
    """n, estimate, ci_low, ci_high of a mean (or proportion), resampling rows or whole groups.

    Rows are reduced to (value, count), or to (sum, count) per group.  In every resample each unit
    comes as often as a Poisson variable of mean one says, drawn from a generator keyed by the
    seed and the unit, so that units are drawn wherever they lie and only the sums of the
    resamples, two numbers each, leave a task.  Empty inputs give one row of nulls and n 0.
    """
    import numpy as np

    x = rows.where(F.col(value).isNotNull()).withColumn("x", F.col(value).cast("double"))
    reduced = x.groupBy(F.col(group).alias("g")).agg(F.sum("x").alias("s"), F.count("*").alias("c"), F.lit(1).alias("units")) if group else x.groupBy("x").agg(F.count("*").alias("units")).select(F.col("x").cast("string").alias("g"), F.col("x").alias("s"), F.lit(1).alias("c"), "units")
    keyed = reduced.select(F.xxhash64(F.lit(seed), "g").alias("h"), "s", "c", "units")

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s, c = np.zeros(resamples), np.zeros(resamples)
        for b in batches:
            for h, si, ci, units in zip(b["h"].to_numpy(), b["s"].to_numpy(), b["c"].to_numpy(), b["units"].to_numpy(), strict=True):
                w = np.random.Generator(np.random.Philox(key=int(h) & 0xFFFFFFFFFFFFFFFF)).poisson(units, resamples)
                s += w * si
                c += w * ci
        if c.any():
            yield pd.DataFrame({"i": np.arange(resamples), "s": s, "c": c})

    sums = keyed.mapInPandas(draw, "i bigint, s double, c double").groupBy("i").agg(F.sum("s").alias("s"), F.sum("c").alias("c"))
    # at most `resamples` numbers
    means = sums.agg(F.array_sort(F.collect_list(F.col("s") / F.greatest(F.lit(1.0), F.col("c")))).alias("m"))
    lo, hi = int((1 - level) / 2 * resamples), min(resamples - 1, int((1 + level) / 2 * resamples))
    whole = reduced.agg(F.coalesce(F.sum(F.col("units") * F.col("c")), F.lit(0)).alias("n"), F.sum(F.col("units") * F.col("s")).alias("t"))
    return whole.crossJoin(means).select("n", (F.col("t") / F.col("n")).alias("estimate"), F.get("m", F.lit(lo)).alias("ci_low"), F.get("m", F.lit(hi)).alias("ci_high"))  # one row each


def pearson(rows: DataFrame, a: str, b: str) -> DataFrame:
    """One row: r; 1 if both columns are constant, 0 if one is."""
    s = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).agg(F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)).alias("r"), F.var_pop(a).alias("va"), F.var_pop(b).alias("vb"))
    flat_a, flat_b = F.col("va") <= 1e-12, F.col("vb") <= 1e-12
    return s.select(F.when(flat_a & flat_b, 1.0).when(flat_a | flat_b, 0.0).otherwise(F.round("r", 6)).alias("r"))


#: Older forms of directions.
FORWARD, BACKWARD = ("A_TO_B", "A_CONFIRMS_B", "A_REFINES_B"), ("B_TO_A", "B_CONFIRMS_A", "B_REFINES_A")
DIRECTED = ("SUPPORTS", "REFINES")


def axis(direction: Column) -> Column:
    """A_TO_B, B_TO_A or SYMMETRIC of a direction in any form; null where it names none."""
    d = F.upper(F.trim(direction))
    return F.when(d.isin(*FORWARD), "A_TO_B").when(d.isin(*BACKWARD), "B_TO_A").when(d == "SYMMETRIC", "SYMMETRIC")


def direction_metrics(rows: DataFrame, z: float = 1.96) -> DataFrame:
    """metric, n, k, rate, ci_low, ci_high (Wilson) of directions against gold ones.

    rows: gold_label, gold_direction, label, direction.  D1: label and direction right, of all gold
    directed rows; D2: direction right, of the same; D3: label and direction right as one, of all rows, where
    undirected labels need no direction; D4: direction right, of the rows whose label is right and directed.
    """
    directed = F.col("gold_label").isin(*DIRECTED)
    label_ok = F.coalesce(F.col("label") == F.col("gold_label"), F.lit(False))
    way_ok = F.coalesce(axis(F.col("direction")) == axis(F.col("gold_direction")), F.lit(False))
    kinds = {
        "D1": (directed, label_ok & way_ok), "D2": (directed, way_ok),
        "D3": (F.lit(True), label_ok & (way_ok | ~directed)), "D4": (directed & label_ok, way_ok),
    }
    x = rows.where(F.col("gold_label").isNotNull()).select(F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), a.alias("of"), (a & b).alias("hit")) for k, (a, b) in kinds.items()])).alias("x")).select("x.*")
    s = x.groupBy("metric").agg(F.count_if("of").alias("n"), F.count_if("hit").alias("k"))
    n, rate = F.greatest(F.lit(1), F.col("n")), F.col("k") / F.greatest(F.lit(1), F.col("n"))
    middle, half = (rate + z * z / (2 * n)) / (1 + z * z / n), z / (1 + z * z / n) * F.sqrt(rate * (1 - rate) / n + z * z / (4 * n * n))
    return s.select("metric", "n", "k", F.round(rate, 6).alias("rate"), F.round(F.greatest(F.lit(0.0), middle - half), 6).alias("ci_low"), F.round(F.least(F.lit(1.0), middle + half), 6).alias("ci_high"))


def entropy3(p1: Column, p2: Column, p3: Column) -> Column:
    """Entropy to the base 3; zero probabilities add nothing."""
    term = lambda p: F.when(p > 0, -p * F.log(p) / F.log(F.lit(3.0))).otherwise(0.0)
    return term(p1) + term(p2) + term(p3)


def family_split(rows: DataFrame, category: str, family: str, share: float = 0.35) -> DataFrame:
    """category, family, split: per category the first max(1, round(share n)) families by the digest of their name go to test, others to dev."""
    f = rows.where(F.col(category).isNotNull() & F.col(family).isNotNull()).select(F.col(category).alias("category"), F.col(family).alias("family")).distinct()
    w = Window.partitionBy("category")
    r = f.withColumn("r", F.row_number().over(w.orderBy(F.sha2("family", 256), "family"))).withColumn("n", F.count("*").over(w))
    return r.select("category", "family", F.when(F.col("r") <= F.greatest(F.lit(1), F.bround(F.lit(share) * F.col("n"))), "test").otherwise("dev").alias("split"))


def quotas(rows: DataFrame, stratum: str, total: int) -> DataFrame:
    """stratum, n, quota: proportional allocation of `total` by largest remainder, ties by name, at most n."""
    c = rows.groupBy(F.col(stratum).alias("stratum")).agg(F.count("*").alias("n"))
    all_ = c.agg(F.sum("n").alias("t"))
    x = c.crossJoin(F.broadcast(all_)).withColumn("exact", F.lit(float(total)) * F.col("n") / F.col("t")).withColumn("base", F.floor("exact"))
    w = Window.orderBy((F.col("exact") - F.col("base")).desc(), "stratum")
    left = F.lit(total) - F.sum("base").over(Window.partitionBy(F.lit(1)))
    return x.withColumn("left", left).withColumn("r", F.row_number().over(w)).select("stratum", "n", F.least(F.col("n"), F.col("base") + (F.col("r") <= F.col("left")).cast("int")).alias("quota"))


def stratified_sample(rows: DataFrame, stratum: str, key: str, total: int, seed: str = "sample") -> DataFrame:
    """rows of the sample: per stratum its quota of rows by the order of the digest of their key, then the key."""
    q = quotas(rows, stratum, total).select(F.col("stratum").alias(stratum), "quota")
    digest = F.sha2(F.concat_ws(":", F.lit(seed), F.col(key).cast("string")), 256)
    keyed = rows.withColumn("digest_", digest)
    return first_of_groups(keyed, stratum, [F.col("digest_"), F.col(key)], q, Scratch(rows.sparkSession, "sample")).drop("digest_")


def evidence_conflicts(rows: DataFrame, claim: str, score: str, threshold: float = 0.5) -> DataFrame:
    """claim, n_conflicts, penalty: pairs of a value at or above and one below the threshold, .10 each, penalty at most 1; counted, not paired."""
    c = rows.groupBy(F.col(claim).alias("claim")).agg(F.count_if(F.col(score) >= threshold).alias("up"), F.count_if(F.col(score) < threshold).alias("down"))
    n = F.col("up") * F.col("down")
    return c.where(n > 0).select("claim", n.alias("n_conflicts"), F.round(F.least(F.lit(1.0), 0.10 * n), 6).alias("penalty"))


#: Weights of the coverage components and levels of the verification index.
COVERAGE = {"experiments": 0.30, "claims": 0.25, "reproducibility": 0.20, "artifacts": 0.10, "statistics": 0.10, "documentation": 0.05}
INDEX_LEVELS = ((95, "exemplary"), (85, "strong"), (75, "adequate"), (60, "partial"), (40, "weak"))


def verification_index(results: DataFrame, weights: dict[str, float]) -> DataFrame:
    """One row: pass rate per dimension weighted over the measured dimensions only, in percent, and its level.

    results: (dimension, passed); null passed is not measured.
    """
    spark = results.sparkSession
    w = spark.createDataFrame(list(weights.items()), "dimension string, weight double")
    rate = results.where(F.col("passed").isNotNull()).groupBy("dimension").agg(F.avg(F.col("passed").cast("double")).alias("rate"))
    s = rate.join(F.broadcast(w), "dimension").agg(F.sum(F.col("rate") * F.col("weight")).alias("x"), F.sum("weight").alias("w"))
    value = F.when(F.col("w") > 0, 100 * F.col("x") / F.col("w")).otherwise(0.0)
    level = F.when(F.lit(False), "")
    for least, name in INDEX_LEVELS:
        level = level.when(value >= least, name)
    return s.select(F.round(value, 6).alias("index"), level.otherwise("insufficient").alias("level"))


def gate_ladder(gates: DataFrame) -> DataFrame:
    """gate, position, state: gates in order; the first that fails is "blocked", later ones "not reached"."""
    w = Window.orderBy("position").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    failed = F.sum((~F.col("passed")).cast("int")).over(w)
    return gates.select("gate", "position", F.when(failed == 0, "passed").when((failed == 1) & ~F.col("passed"), "blocked").otherwise("not reached").alias("state"))


def template_held_out(rows: DataFrame, family: str, share: float = 0.2, seed: str = "held-out") -> DataFrame:
    """rows with held_out: whole template families by the digest of their name, about `share` of the families; without a family false."""
    digits = F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(seed), F.lower(F.trim(family))), 256), 1, 8), 16, 10).cast("bigint")
    known = F.coalesce(F.trim(family) != "", F.lit(False))
    return rows.withColumn("held_out", known & (digits < F.lit(int(share * 2**32))))


def retrieval_benchmark(ranked: DataFrame, relevant: DataFrame, k: int = 10) -> DataFrame:
    """One row: n_queries, precision, recall, mean reciprocal rank and nDCG at k.

    ranked: (query, item, rank from 1); relevant: (query, item).  Queries without relevant items take no
    part; repeated rows count once, at their best rank.
    """
    rel = relevant.where("query is not null and item is not null").select("query", "item").distinct()
    per = rel.groupBy("query").agg(F.count("*").alias("n_rel"))
    top = ranked.where(F.col("rank") <= k).groupBy("query", "item").agg(F.min("rank").alias("rank")).join(rel, ["query", "item"])
    got = top.groupBy("query").agg(F.count("*").alias("hits"), F.min("rank").alias("first"), F.sum(1 / F.log2(F.col("rank") + 1)).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.lit(k), F.col("n_rel").cast("int"))), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + F.lit(1)))
    x = per.join(got, "query", "left")
    z = lambda c: F.coalesce(c, F.lit(0.0))
    return x.agg(
        F.count("*").alias("n_queries"), F.round(F.avg(z(F.col("hits") / k)), 6).alias("precision"), F.round(F.avg(z(F.col("hits") / F.col("n_rel"))), 6).alias("recall"),
        F.round(F.avg(z(1 / F.col("first"))), 6).alias("mrr"), F.round(F.avg(z(F.col("dcg")) / ideal), 6).alias("ndcg"),
    )


def coverage_index(parts: DataFrame) -> DataFrame:
    """One row: coverage, n_missing: weighted share of what each component holds of what it should (at most all), components without rows counting 0.

    parts: (component, present, expected); components are those of COVERAGE, others are ignored.
    """
    w = parts.sparkSession.createDataFrame(list(COVERAGE.items()), "component string, weight double")
    s = parts.groupBy("component").agg(F.sum("present").alias("p"), F.sum("expected").alias("e"))
    share = F.when(F.col("e") > 0, F.least(F.lit(1.0), F.col("p") / F.col("e"))).otherwise(0.0)
    return F.broadcast(w).join(s, "component", "left").agg(F.round(100 * F.sum(F.col("weight") * F.coalesce(share, F.lit(0.0))), 6).alias("coverage"), F.count_if(F.coalesce(share, F.lit(0.0)) < 1).alias("n_missing"))


def three_way(rows: DataFrame, gold: str = "gold", predicted: str = "predicted") -> DataFrame:
    """One row: n, accuracy, macro_f1, n_abstained of labels collapsed to SUPPORTS, REFUTES and NOT ENOUGH INFO; a null prediction abstains as the last."""
    fold = lambda c: F.when(c.isin("SUPPORTS", "REFINES", "EQUIVALENT"), "SUPPORTS").when(c == "CONTRADICTS", "REFUTES").otherwise("NOT ENOUGH INFO")
    x = rows.where(F.col(gold).isNotNull()).select(fold(F.col(gold)).alias("gold"), fold(F.coalesce(F.col(predicted), F.lit("UNKNOWN"))).alias("predicted"), F.col(predicted).isNull().alias("none"))
    one = x.agg(F.count("*").alias("n"), F.round(F.avg((F.col("gold") == F.col("predicted")).cast("double")), 6).alias("accuracy"), F.count_if("none").alias("n_abstained"))
    return one.crossJoin(averages(prf(x)).select("macro_f1"))  # one row each


def claim_assessment(support: DataFrame, levels: tuple[tuple[float, str], ...] = ((0.8, "well supported"), (0.5, "partly supported"), (0.0, "weakly supported"))) -> DataFrame:
    """claim, n, score, level: the mean score of a claim's supporting results, less .10 per conflicting one, at least 0; without results "unsupported".

    support: (claim, score, conflicts) with null scores where a claim has no result.
    """
    s = support.groupBy("claim").agg(F.count("score").alias("n"), F.when(F.count("score") > 0, F.greatest(F.lit(0.0), F.avg("score") - 0.10 * F.coalesce(F.sum("conflicts"), F.lit(0)))).alias("s"))
    level = F.when(F.col("n") == 0, "unsupported")
    for least, name in levels:
        level = level.when(F.col("s") >= least, name)
    return s.select("claim", "n", F.round("s", 9).alias("score"), level.alias("level"))


def readiness(criteria: DataFrame) -> DataFrame:
    """One row: met, partial, missing, share, level: "ready" if all are met, "nearly ready" from .8 of the points, "in progress" from .5, else "not ready".

    criteria: (criterion, share of it that holds); 1 is met, 0 or null missing, anything between partial and half a point.
    """
    x = F.coalesce(F.col("share"), F.lit(0.0))
    s = criteria.agg(F.count("*").alias("n"), F.count_if(x >= 1).alias("met"), F.count_if((x > 0) & (x < 1)).alias("partial"), F.count_if(x <= 0).alias("missing"))
    points = (F.col("met") + 0.5 * F.col("partial")) / F.greatest(F.lit(1), F.col("n"))
    level = F.when((F.col("n") > 0) & (F.col("met") == F.col("n")), "ready").when(points >= 0.8, "nearly ready").when(points >= 0.5, "in progress").otherwise("not ready")
    return s.select("met", "partial", "missing", F.round(points, 6).alias("share"), level.alias("level"))


def binary(rows: DataFrame, gold: str, predicted: str) -> DataFrame:
    """One row: tp, fp, fn, tn, precision, recall, f1, accuracy, macro_f1 of two boolean columns; rows with a null gold are left out."""
    g, p = F.col(gold), F.coalesce(F.col(predicted), F.lit(False))
    s = rows.where(g.isNotNull()).agg(F.count_if(g & p).alias("tp"), F.count_if(~g & p).alias("fp"), F.count_if(g & ~p).alias("fn"), F.count_if(~g & ~p).alias("tn"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    f1, f0 = ratio(2 * tp, 2 * tp + fp + fn), ratio(2 * tn, 2 * tn + fp + fn)
    values = {"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": f1, "accuracy": ratio(tp + tn, tp + fp + fn + tn), "macro_f1": (f1 + f0) / 2}
    return s.select("tp", "fp", "fn", "tn", *[F.round(v, 6).alias(k) for k, v in values.items()])


#: Fixed value: endings of malformed claims.
MALFORMED = r"(and\s*\.$)|(:$)|([,;]\s*\.$)|(\(\s*$)"


def error_reason(gold: Column, predicted: Column, text_a: Column, text_b: Column, score_ab: Column, score_ba: Column, least: float = 0.5) -> Column:
    """Why a gold relation was missed, null where it was not.

    never_scored without any score; malformed_claim where a text is missing or ends badly;
    model_missed where the score of the gold relation's kind is below `least` both ways; else routing: the
    score was there and another rule decided.
    """
    bad = lambda t: t.isNull() | F.trim(t).rlike(MALFORMED)
    low = lambda s: F.coalesce(s, F.lit(0.0)) < least
    return (
        F.when(gold.isNull() | gold.eqNullSafe(predicted), F.lit(None).cast("string")).when(score_ab.isNull() & score_ba.isNull(), "never_scored").when(bad(text_a) | bad(text_b), "malformed_claim")
        .when(low(score_ab) & low(score_ba), "model_missed").otherwise("routing")
    )


def gold_predictions(gold: DataFrame, relations: DataFrame) -> DataFrame:
    """gold with predicted, the relation type of the same unordered pair of claims (the least of several), null without one."""
    pair = lambda: (F.least("claim_id_a", "claim_id_b").alias("x_"), F.greatest("claim_id_a", "claim_id_b").alias("y_"))
    p = relations.groupBy(*pair()).agg(F.min("relation_type").alias("predicted"))
    return gold.select("*", *pair()).join(p, ["x_", "y_"], "left").drop("x_", "y_")


def acceptance(metrics: dict[str, float], criteria: dict[str, float], lower_is_better: frozenset[str] = frozenset()) -> str:
    """failed if a metric misses its threshold, warning if one is not measured before that, else passed; criteria in their order."""
    for name, threshold in criteria.items():
        if name not in metrics:
            return "warning"
        if metrics[name] > threshold if name in lower_is_better else metrics[name] < threshold:
            return "failed"
    return "passed"
