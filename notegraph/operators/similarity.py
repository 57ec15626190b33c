"""Exact similarity joins over vectors, pair validation, density and recall."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Vectors of one piece of the blocked join, and pivots at most.
BLOCK, MOST_PIVOTS = 4096, 1024


def top_k_pairs(vectors: DataFrame, key: str, vector: str, k: int = 50, threshold: float = 0.75, block: int = BLOCK) -> DataFrame:
    """a, b, score, rank: every key's k most similar others by inner product, exact, kept where score >= threshold.

    Rows go to the nearest of some pivots, a pivot with many rows being cut by hash into pieces of
    about `block`.  Two pivots meet only if their angle, less the angles of their farthest rows,
    leaves room for a score of `threshold`; every two pieces that may meet do so once as one
    matrix product, and the k best of all pieces are merged.  No task holds more than two pieces.
    Where rows do not cluster, or the threshold is low, all pieces meet: work then grows with the
    square of the rows.  Ties by key.  Null vectors take no part; lengths need not be one.
    """
    rows = vectors.where(F.col(vector).isNotNull()).select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v"))
    kind = dict(rows.dtypes)["key"]
    n = rows.count()
    if not n:
        return rows.select(F.col("key").alias("a"), F.col("key").alias("b"), F.lit(0.0).alias("score"), F.lit(1).alias("rank")).where("false")
    m = min(MOST_PIVOTS, -(-n // block))
    # at most MOST_PIVOTS rows
    some = np.array([r["v"] for r in rows.orderBy(F.xxhash64(F.lit("pivot"), "key"), "key").limit(m).collect()]).reshape(m, -1)
    pivots = some / np.maximum(np.linalg.norm(some, axis=1, keepdims=True), 1e-300)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                x = np.stack(b["v"].to_numpy())
                length = np.linalg.norm(x, axis=1)
                s = (x / np.maximum(length, 1e-300)[:, None]) @ pivots.T
                at = s.argmax(axis=1)
                yield pd.DataFrame({"key": b["key"], "v": b["v"], "pivot": at, "angle": np.arccos(np.clip(s[np.arange(len(at)), at], -1, 1)), "length": length})

    placed = rows.mapInPandas(place, f"key {kind}, v array<double>, pivot int, angle double, length double")
    around = {r["pivot"]: r for r in placed.groupBy("pivot").agg(F.max("angle").alias("angle"), F.max("length").alias("length"), F.count("*").alias("n")).collect()}
    radius, length, pieces = np.zeros(m), np.zeros(m), np.zeros(m, dtype=int)
    for i, r in around.items():
        radius[i], length[i], pieces[i] = r["angle"], r["length"], -(-r["n"] // block)
    apart = np.maximum(0.0, np.arccos(np.clip(pivots @ pivots.T, -1, 1)) - radius[:, None] - radius[None, :])
    # obtuse angles bound the product by zero, whatever the lengths
    near = (length[:, None] * length[None, :] * np.maximum(0.0, np.cos(np.minimum(apart, np.pi))) >= threshold - 1e-9) & (pieces[:, None] > 0) & (pieces[None, :] > 0)
    first = np.concatenate([[0], np.cumsum(pieces)])
    # pieces that a pivot's rows ask, and pieces that ask them: `near` is symmetric
    meets = rows.sparkSession.createDataFrame([(i, int(first[i]), int(max(1, pieces[i])), [int(c) for j in np.flatnonzero(near[i]) for c in range(first[j], first[j + 1])]) for i in range(m)], "pivot int, first int, pieces int, others array<int>")
    cell = F.col("first") + F.pmod(F.xxhash64("key"), F.col("pieces")).cast("int")
    known = placed.join(F.broadcast(meets), "pivot").select("key", "v", cell.alias("cell"), "others")  # one row per pivot
    asks = known.select(F.explode("others").alias("j"), F.col("cell").alias("i"), "key", "v", F.lit(True).alias("asks"))
    holds = known.select(F.col("cell").alias("j"), F.explode("others").alias("i"), "key", "v", F.lit(False).alias("asks"))

    def meet(g: pd.DataFrame) -> pd.DataFrame:
        q, h = g[g["asks"]].sort_values("key"), g[~g["asks"]].sort_values("key")
        if not len(q) or not len(h):
            return pd.DataFrame({"a": [], "b": [], "score": []})
        s = np.stack(q["v"].to_numpy()) @ np.stack(h["v"].to_numpy()).T
        qk, hk = q["key"].to_numpy(), h["key"].to_numpy()
        s[qk[:, None] == hk[None, :]] = -np.inf
        s = np.round(s, 9)
        top = np.argsort(-s, axis=1, kind="stable")[:, :k]
        best = np.take_along_axis(s, top, 1)
        keep = np.isfinite(best) & (best >= threshold)
        return pd.DataFrame({"a": np.repeat(qk, keep.sum(1)), "b": hk[top[keep]], "score": best[keep]})

    found = asks.unionByName(holds).groupBy("i", "j").applyInPandas(meet, f"a {kind}, b {kind}, score double")
    w = Window.partitionBy("a").orderBy(F.col("score").desc(), "b")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def candidates(ranked: DataFrame) -> DataFrame:
    """claim_id_a, claim_id_b (smaller first), score, rank of ranked pairs: each unordered pair once, as its first query saw it."""
    keyed = ranked.select(F.least("a", "b").alias("claim_id_a"), F.greatest("a", "b").alias("claim_id_b"), "a", "score", "rank")
    w = Window.partitionBy("claim_id_a", "claim_id_b").orderBy("a")
    return keyed.withColumn("o", F.row_number().over(w)).where("o = 1").select("claim_id_a", "claim_id_b", "score", "rank")


def unordered_pairs(pairs: DataFrame) -> DataFrame:
    """Candidate pairs once per unordered pair, the first by run, rank and cosine; self pairs and null ends are dropped."""
    keyed = pairs.where("claim_id_a is not null and claim_id_b is not null and claim_id_a != claim_id_b").select(
        F.least("claim_id_a", "claim_id_b").alias("x"), F.greatest("claim_id_a", "claim_id_b").alias("y"), "run_id", "cosine_similarity", "candidate_rank"
    )
    w = Window.partitionBy("x", "y").orderBy("run_id", "candidate_rank", F.desc_nulls_last("cosine_similarity"))
    return keyed.withColumn("o", F.row_number().over(w)).where("o = 1").select(F.col("x").alias("claim_id_a"), F.col("y").alias("claim_id_b"), "cosine_similarity", "candidate_rank")


def density(pairs: DataFrame, threshold: float = 0.75, dense: int = 20, isolated: int = 1) -> DataFrame:
    """claim_id, n_neighbors, density: dense above `dense` neighbours at the threshold, isolated up to `isolated`."""
    ends = pairs.select(F.explode(F.array("claim_id_a", "claim_id_b")).alias("claim_id"), "cosine_similarity")
    n = ends.groupBy("claim_id").agg(F.count_if(F.coalesce(F.col("cosine_similarity") >= threshold, F.lit(False))).alias("n_neighbors"))
    return n.withColumn("density", F.when(F.col("n_neighbors") > dense, "dense").when(F.col("n_neighbors") <= isolated, "isolated").otherwise("normal"))


def validate_pairs(pairs: DataFrame, claims: DataFrame, embedded: DataFrame, threshold: float = 0.75) -> DataFrame:
    """pairs with rejection_reason: self_pair, missing_claim, missing_embedding, below_threshold in this order, else null."""
    c = claims.select("claim_id").distinct().withColumn("has_claim", F.lit(True))
    e = embedded.select("claim_id").distinct().withColumn("has_vector", F.lit(True))
    out = pairs
    for x in "ab":
        out = out.join(c.withColumnsRenamed({"claim_id": f"claim_id_{x}", "has_claim": f"claim_{x}"}), f"claim_id_{x}", "left").join(e.withColumnsRenamed({"claim_id": f"claim_id_{x}", "has_vector": f"vector_{x}"}), f"claim_id_{x}", "left")
    reason = (
        F.when(F.col("claim_id_a") == F.col("claim_id_b"), "self_pair").when(F.col("claim_a").isNull() | F.col("claim_b").isNull(), "missing_claim")
        .when(F.col("vector_a").isNull() & F.col("vector_b").isNull(), "missing_embedding").when(F.coalesce(F.col("cosine_similarity") < threshold, F.lit(True)), "below_threshold")
    )
    return out.withColumn("rejection_reason", reason).drop("claim_a", "claim_b", "vector_a", "vector_b")


def recall_sweep(ranked: DataFrame, gold: DataFrame, ks: tuple[int, ...], thresholds: tuple[float, ...], n_queries: int) -> DataFrame:
    """k, threshold, recall, candidates_per_query: gold pairs (a, b) found among ranked pairs for every k and threshold."""
    spark = ranked.sparkSession
    grid = spark.createDataFrame([(k, t) for k in ks for t in thresholds], "k int, threshold double")
    cand = ranked.join(F.broadcast(grid), (F.col("rank") <= F.col("k")) & (F.col("score") >= F.col("threshold")))
    pairs = cand.select("k", "threshold", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    g = gold.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().withColumn("gold", F.lit(1))
    total = g.count()
    got = pairs.join(g, ["a", "b"], "left").groupBy("k", "threshold").agg(F.count("gold").alias("hits"), F.count("*").alias("n"))
    return grid.join(got, ["k", "threshold"], "left").select(
        "k", "threshold", F.round(F.coalesce("hits", F.lit(0)) / F.lit(max(1, total)), 6).alias("recall"), F.round(F.coalesce("n", F.lit(0)) / F.lit(max(1, n_queries)), 6).alias("candidates_per_query")
    )
