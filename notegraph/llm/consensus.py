"""Problem 3: consensus labels, agreement and annotator reliability by expectation-maximisation."""

from __future__ import annotations

import math
import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notegraph.lineage import Scratch
from notegraph.operators.joins import salted

#: The relation labels of a vote.
LABELS = ("NEUTRAL", "SUPPORTS", "REFINES", "CONTRADICTS", "EQUIVALENT")
DIRECTED = ("SUPPORTS", "REFINES")
DIRECTIONS = ("A_TO_B", "B_TO_A")


def _trimmed(col: Column) -> Column:
    return F.upper(F.regexp_replace(col, r"(?U)^\s+|\s+$", ""))


def latest_votes(*passes: DataFrame) -> DataFrame:
    """id, annotator_id, label, way: the valid votes, one per id and annotator.

    Per id and annotator only the row with the latest annotated_at over all passes is looked at
    (null counts as earliest; of equal times the greatest label, then direction, decides); where
    that row holds no valid label there is no vote.  Rows with null id or annotator are no votes.
    way is A_TO_B or B_TO_A where the vote is directed and says so, else null.
    """
    rows = None
    for p in passes:
        part = p.select("id", "annotator_id", F.struct("annotated_at", _trimmed(F.col("label")).alias("label"), _trimmed(F.col("direction")).alias("direction")).alias("v"))
        rows = part if rows is None else rows.unionByName(part)
    last = rows.where("id is not null and annotator_id is not null").groupBy("id", "annotator_id").agg(F.max("v").alias("v"))
    way = (
        F.when(~F.col("v.label").isin(*DIRECTED), None)
        .when(F.col("v.direction").rlike("^A_[A-Z]+_B$"), DIRECTIONS[0])
        .when(F.col("v.direction").rlike("^B_[A-Z]+_A$"), DIRECTIONS[1])
    )
    return last.where(F.col("v.label").isin(*LABELS)).select("id", "annotator_id", F.col("v.label").alias("label"), way.alias("way"))


class DawidSkene:
    """Confusion matrices and label posteriors by EM with smoothing.

    votes: (id, annotator_id, label).  Per annotator the confusion counts are smoothed with
    `strength` pseudo-votes spread as the pooled confusion matrix, which itself gets one
    pseudo-vote per cell; so annotators with few votes behave as the average one.  Every
    round is one job over the votes; between rounds only the counts per annotator and label
    are kept, in a written table, and the k x k pooled sums go to the driver.  Rounds end when no
    pooled probability moves by `tolerance`; after `rounds` of them `converged` is false and a warning given.
    """

    def __init__(self, votes: DataFrame, labels: tuple[str, ...], scratch: Scratch, strength: float = 6.0, rounds: int = 50, tolerance: float = 2e-4):
        self.labels, self.k, self.scratch, self.strength = labels, len(labels), scratch, strength
        code = F.array_position(F.array(*[F.lit(x) for x in labels]), F.col("label")).cast("int") - 1
        plain = votes.select("id", "annotator_id", code.alias("l"))
        sizes = plain.groupBy("id").agg(F.count("*").alias("n"))
        self.votes = scratch.table(plain.join(sizes, "id"))
        start = self.votes.groupBy("id", "n").agg(*[F.sum(F.when(F.col("l") == k, 1.0).otherwise(0.0)).alias(f"s{k}") for k in range(self.k)])
        first = start.select("id", *[((F.col(f"s{k}") + 0.2) / (F.col("n") + 0.2 * self.k)).alias(f"p{k}") for k in range(self.k)])
        self.counts = self._counts(first)
        last = None
        self.converged = False
        for _ in range(rounds):
            self._pool()
            counts = self._counts(self.posteriors())
            scratch.drop(self.counts)
            self.counts = counts
            now = [x for row in self.pooled for x in row] + self.prior
            if last and max(abs(x - y) for x, y in zip(now, last, strict=True)) < tolerance:
                self.converged = True
                break
            last = now
        if not self.converged:
            warnings.warn(f"the label model still moved after {rounds} rounds", RuntimeWarning, stacklevel=2)
        self._pool()

    def _counts(self, posteriors: DataFrame) -> DataFrame:
        joined = self.votes.join(posteriors, "id")
        return self.scratch.table(
            joined.groupBy("annotator_id", "l").agg(
                *[F.sum(f"p{k}").alias(f"c{k}") for k in range(self.k)],
                *[F.sum(F.col(f"p{k}") / F.col("n")).alias(f"q{k}") for k in range(self.k)],
                F.count("*").alias("votes"),
            )
        )

    def _pool(self) -> None:
        k = self.k
        sums = {r["l"]: r for r in self.counts.groupBy("l").agg(*[F.sum(f"{x}{i}").alias(f"{x}{i}") for x in "cq" for i in range(k)]).collect()}
        cell = [[(sums[j][f"c{i}"] if j in sums else 0.0) + 1.0 for j in range(k)] for i in range(k)]
        self.pooled = [[x / sum(row) for x in row] for row in cell]
        mass = [sum(r[f"q{i}"] for r in sums.values()) + 1.0 for i in range(k)]
        self.prior = [x / sum(mass) for x in mass]

    def confusion(self) -> DataFrame:
        """annotator_id, l, votes, t0..: smoothed probability of vote l by true label, for the labels the annotator used."""
        by = Window.partitionBy("annotator_id")
        spread = F.array(*[F.array(*[F.lit(self.pooled[i][j]) for j in range(self.k)]) for i in range(self.k)])
        return self.counts.select(
            "annotator_id", "l", "votes",
            *[
                ((F.col(f"c{i}") + self.strength * F.element_at(F.element_at(spread, i + 1), F.col("l") + 1)) / (F.sum(f"c{i}").over(by) + self.strength)).alias(f"t{i}")
                for i in range(self.k)
            ],
        )

    def posteriors(self) -> DataFrame:
        """id, p0..: the probability of each true label."""
        k = self.k
        logs = self.confusion().select("annotator_id", "l", *[F.log(f"t{i}").alias(f"w{i}") for i in range(k)])
        sums = salted(self.votes, logs, ["annotator_id", "l"], "id").groupBy("id").agg(*[(F.sum(f"w{i}") + math.log(self.prior[i])).alias(f"w{i}") for i in range(k)])
        top = F.greatest(*[F.col(f"w{i}") for i in range(k)])
        odds = sums.select("id", *[F.exp(F.col(f"w{i}") - top).alias(f"e{i}") for i in range(k)])
        whole = sum((F.col(f"e{i}") for i in range(1, k)), F.col("e0"))
        return odds.select("id", *[(F.col(f"e{i}") / whole).alias(f"p{i}") for i in range(k)])

    def best(self, name: str) -> DataFrame:
        """id, the most probable label (the first of LABELS on equal probability) and its probability."""
        pick = F.array_max(F.array(*[F.struct(F.col(f"p{i}").alias("p"), F.lit(-i).alias("o"), F.lit(x).alias("x")) for i, x in enumerate(self.labels)]))
        return self.posteriors().select("id", pick["x"].alias(name), pick["p"].alias(f"{name}_probability"))


def consensus(*passes: DataFrame, least_votes: int = 3) -> tuple[DataFrame, DawidSkene, DataFrame]:
    """(id, label, direction, label_probability, n_votes), the label model and the votes.

    One row per id with at least `least_votes` valid votes; all votes train the models.  The
    direction of a directed label comes from a second model over the directed votes alone; an id
    whose votes name no direction gets A_TO_B.  Other labels are SYMMETRIC.
    """
    scratch = Scratch(passes[0].sparkSession, "consensus")
    votes = scratch.table(latest_votes(*passes))
    model = DawidSkene(votes, LABELS, scratch)
    ways = DawidSkene(votes.where("way is not null").select("id", "annotator_id", F.col("way").alias("label")), DIRECTIONS, scratch, strength=4.0)
    sizes = votes.groupBy("id").agg(F.count("*").alias("n_votes"))
    out = (
        model.best("label").join(sizes.where(F.col("n_votes") >= least_votes), "id").join(ways.best("way"), "id", "left")
        .select("id", "label", F.when(F.col("label").isin(*DIRECTED), F.coalesce("way", F.lit(DIRECTIONS[0]))).otherwise("SYMMETRIC").alias("direction"), "label_probability", "n_votes")
    )
    return out, model, votes


def reliability(*passes: DataFrame) -> DataFrame:
    """annotator_id, n_votes, expected_accuracy (prior-weighted diagonal of the confusion matrix), agreement_with_consensus."""
    out, model, votes = consensus(*passes, least_votes=1)
    hit = sum((F.when(F.col("l") == i, F.col(f"t{i}") * model.prior[i]).otherwise(0.0) for i in range(1, model.k)), F.when(F.col("l") == 0, F.col("t0") * model.prior[0]).otherwise(0.0))
    trust = model.confusion().groupBy("annotator_id").agg(F.sum("votes").alias("n_votes"), F.sum(hit).alias("expected_accuracy"))
    met = votes.join(out.select("id", F.col("label").alias("consensus")), "id").groupBy("annotator_id").agg(F.avg((F.col("label") == F.col("consensus")).cast("double")).alias("agreement_with_consensus"))
    return trust.join(met, "annotator_id").select("annotator_id", "n_votes", F.round("expected_accuracy", 6).alias("expected_accuracy"), F.round("agreement_with_consensus", 6).alias("agreement_with_consensus"))


def agreement(*passes: DataFrame) -> DataFrame:
    """One row: Krippendorff's alpha (nominal) over ids with two votes or more, with its observed and expected disagreement.

    alpha is null where expected disagreement is zero or no id has two votes.
    """
    per = latest_votes(*passes).groupBy("id", "label").agg(F.count("*").alias("n"))
    size = per.groupBy("id").agg(F.sum("n").alias("m")).where("m > 1")
    cells = per.join(size, "id")
    same = cells.agg(
        F.sum(F.col("n") * (F.col("n") - 1) / (F.col("m") - 1)).alias("same"), F.sum("n").alias("total"), F.count_distinct("id").alias("n_ids")
    )
    chance = cells.groupBy("label").agg(F.sum("n").alias("n")).agg(F.sum(F.col("n") * (F.col("n") - 1)).alias("pairs"))
    one = same.withColumn("k", F.lit(1)).join(chance.withColumn("k", F.lit(1)), "k")
    do = 1 - F.col("same") / F.col("total")
    de = 1 - F.col("pairs") / (F.col("total") * (F.col("total") - 1))
    return one.select(
        "n_ids", F.col("total").alias("n_votes"), F.round(do, 6).alias("observed_disagreement"), F.round(de, 6).alias("expected_disagreement"),
        F.round(1 - do / F.when(de > 0, de), 6).alias("alpha"),
    )
