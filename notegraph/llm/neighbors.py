"""Problem 2: the k most similar vectors of every vector, by a forest of random-projection trees."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from notegraph.lineage import Scratch
from notegraph.llm.forest import Forest

DIMENSION = 96
K = 10
THRESHOLD = 0.75
#: Vectors the trees are fitted on at most; every vector is then indexed.
SAMPLE = 131_072
#: Trees; vectors a leaf holds about; leaves asked at BASE_DEPTH, where the number of leaves of a tree is 2 ** depth.
TREES, LEAF, PROBES, BASE_DEPTH = 6, 2500, 16, 5
#: Members of a leaf that one task holds; a larger leaf is cut by hash and asked piece by piece.
PIECE = 200_000
#: How many more than k candidates, and how much lower ones, are reranked exactly, since leaves compare codes of one byte a number.
MARGIN, SLACK = 6, 0.02
_NEAR = "array<struct<c:double,r:bigint>>"


def usable_vectors(embedded: DataFrame, dimension: int = DIMENSION) -> DataFrame:
    """claim_id, key, vec: the unit vector (float32 bytes) of each claim and the digest of its value.

    Per claim_id the row with the latest embedded_at counts (null is earliest; of equal times the
    greatest vector in byte order).  A claim whose latest vector is null, of another dimension, not
    finite or all zero takes no part, nor does a null claim_id.
    """

    def units(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out: list[bytes | None] = []
            for v in b["vector"]:
                x = None if v is None or len(v) != dimension else np.asarray([math.nan if y is None else y for y in v] if getattr(v, "dtype", None) == object else v, dtype=np.float64)
                if x is None or not np.isfinite(x).all() or not x.any():
                    out.append(None)
                else:
                    x = x / np.abs(x).max()
                    out.append((x / np.linalg.norm(x)).astype(np.float32).tobytes())
            yield pd.DataFrame({"claim_id": b["claim_id"], "embedded_at": b["embedded_at"], "vec": out})

    plain = embedded.select("claim_id", "embedded_at", "vector").where("claim_id is not null")
    rows = plain.mapInPandas(units, "claim_id string, embedded_at timestamp_ntz, vec binary" if dict(plain.dtypes)["embedded_at"] == "timestamp_ntz" else "claim_id string, embedded_at timestamp, vec binary")
    last = rows.groupBy("claim_id").agg(F.max(F.struct("embedded_at", "vec")).alias("x"))
    return last.where("x.vec is not null").select("claim_id", F.md5("x.vec").alias("key"), F.col("x.vec").alias("vec"))


def _matrix(column: pd.Series, d: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype=np.float32).reshape(len(column), d)


def depth_for(n: int, leaf: int, sample: int) -> int:
    """Depth of the trees for n vectors: leaves of about `leaf` vectors, or sixteen leaves of fewer on smaller tables.

    A leaf of the sample holds 8 vectors or more, so leaves grow beyond `leaf` where n exceeds sample * leaf / 8.
    """
    wanted = max(4, round(math.log2(max(n, 1) / leaf)))
    return max(1, min(wanted, int(math.log2(max(min(n, sample) / 8, 2)))))


def probes_for(depth: int, probes: int) -> int:
    """Leaves asked: half as much again for every two doublings of leaves beyond BASE_DEPTH, which keeps the recall."""
    return round(probes * 2 ** (max(0, depth - BASE_DEPTH) / 2))


def codes(x: np.ndarray) -> np.ndarray:
    """One signed byte a number, scaled to each row's greatest."""
    return np.round(x * (127 / np.maximum(np.abs(x).max(axis=1, keepdims=True), 1e-30))).astype(np.int8)


def decoded(column: pd.Series, d: int) -> np.ndarray:
    x = np.frombuffer(b"".join(column), dtype=np.int8).reshape(len(column), d).astype(np.float32)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)


def fit_forest(reps: DataFrame, n: int, d: int, trees: int, leaf: int, sample: int) -> Forest:
    """Trees over at most `sample` vectors drawn by the hash of their key."""
    share = min(1.0, 0.9 * sample / max(n, 1))
    some = reps.where(F.pmod(F.xxhash64(F.lit("sample"), "key"), F.lit(1_000_000)) < F.lit(share * 1_000_000)).select("key", "vec").limit(sample).toPandas()
    some = some.sort_values("key")
    return Forest.fit(_matrix(some["vec"], d), trees, depth_for(n, leaf, sample) if len(some) > 1 else 0)


def similar_classes(reps: DataFrame, scratch: Scratch, k: int, least: float, trees: int, leaf: int, probes: int, sample: int, d: int) -> DataFrame:
    """rid, other, cosine: for every distinct vector its k most similar other ones.

    The driver fits the trees on the bounded sample; every vector is then sent, as codes of one
    byte a number, to its own leaf of each tree and to the leaves that its priority queue pops
    first.  Each leaf gives the best candidates by the codes; of all leaves the k + MARGIN best are
    reranked by exact inner products.  Cosines below `least` are left out.
    """
    spark = reps.sparkSession
    n = reps.count()
    fitted = fit_forest(reps, n, d, trees, leaf, sample)
    asked = probes_for(fitted.depth, probes)
    pieces = max(1, -(-n // (fitted.leaves * PIECE)))
    planes = spark.sparkContext.broadcast((fitted.normals, fitted.offsets))

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f = Forest(*planes.value)
        step = max(64, min(2048, 4_000_000 // (f.trees * min(f.inner + 1, 2048) + (asked + f.trees) * (f.depth + 1))))
        for whole in batches:
            for i in range(0, len(whole), step):
                b = whole.iloc[i : i + step]
                x, rid = _matrix(b["vec"], d), b["rid"].to_numpy()
                m = f.margins(x)
                own, also = f.own(m), f.search(m, asked)
                rows = np.arange(len(b))
                at = np.concatenate([np.repeat(rows, own.shape[1]), np.repeat(rows, also.shape[1])])
                flags = pd.DataFrame({"at": at, "leaf": np.concatenate([own.ravel(), also.ravel()]), "member": np.r_[np.ones(own.size, bool), np.zeros(also.size, bool)]})
                flags["asks"] = ~flags["member"]
                flags = flags.groupby(["at", "leaf"], as_index=False, sort=False).max()
                at, c = flags["at"].to_numpy(), codes(x)
                cells = np.array([y.tobytes() for y in c], dtype=object)
                for piece in range(pieces):
                    # a member lies in one piece of its leaf, a question is asked in all
                    member = flags["member"].to_numpy() & (rid[at] % pieces == piece)
                    use = member | flags["asks"].to_numpy()
                    yield pd.DataFrame({"leaf": flags["leaf"].to_numpy()[use] * pieces + piece, "rid": rid[at[use]], "code": cells[at[use]], "member": member[use], "asks": flags["asks"].to_numpy()[use]})

    def candidates(group: pd.DataFrame) -> pd.DataFrame:
        members, asks = group[group["member"]], group[group["asks"]]
        empty = pd.DataFrame({"rid": pd.Series(dtype="int64"), "near": pd.Series(dtype=object)})
        if not len(members) or not len(asks):
            return empty
        x, ids = decoded(members["code"], d), members["rid"].to_numpy()
        rids, nears = [], []
        block = max(1, 16_000_000 // len(ids))
        for i in range(0, len(asks), block):
            part = asks.iloc[i : i + block]
            q, mine = decoded(part["code"], d), part["rid"].to_numpy()
            s = q @ x.T
            width = min(k + MARGIN + 1, len(ids))
            enough = s >= least - SLACK
            if np.count_nonzero(enough) <= width * len(q):
                r, c = np.nonzero(enough)
            else:
                c = np.argpartition(-s, width - 1, axis=1)[:, :width].ravel()
                r = np.repeat(np.arange(len(q)), width)
                r, c = r[enough[r, c]], c[enough[r, c]]
            other = ids[c] != mine[r]
            r, c = r[other], c[other]
            value = s[r, c]
            order = np.lexsort((-value, r))
            r, c, value = r[order], c[order], value[order]
            if not len(r):
                continue
            first = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
            for lo, hi in zip(first, np.r_[first[1:], len(r)], strict=True):
                hi = min(hi, lo + width)
                rids.append(int(mine[r[lo]]))
                nears.append([{"c": float(a), "r": int(b)} for a, b in zip(value[lo:hi], ids[c[lo:hi]], strict=True)])
        return pd.DataFrame({"rid": rids, "near": nears}) if rids else empty

    routed = reps.select("rid", "vec").mapInPandas(route, "leaf bigint, rid bigint, code binary, member boolean, asks boolean")
    found = routed.groupBy("leaf").applyInPandas(candidates, f"rid bigint, near {_NEAR}")
    # the same pair has nearly the same cosine in every leaf: the codes are equal
    flat = F.array_distinct(F.transform(F.flatten(F.collect_list("near")), lambda y: F.struct(F.round(y["c"], 5).alias("c"), y["r"].alias("r"))))
    best = scratch.table(found.groupBy("rid").agg(F.slice(F.sort_array(flat, asc=False), 1, k + MARGIN).alias("near")))
    pairs = best.select("rid", F.explode("near.r").alias("r")).select(F.least("rid", "r").alias("a"), F.greatest("rid", "r").alias("b")).distinct()
    with_a = pairs.join(reps.select(F.col("rid").alias("a"), F.col("vec").alias("va")), "a")
    both = with_a.join(reps.select(F.col("rid").alias("b"), F.col("vec").alias("vb")), "b")

    def exact(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                c = (_matrix(b["va"], d).astype(np.float64) * _matrix(b["vb"], d).astype(np.float64)).sum(axis=1)
                yield pd.DataFrame({"a": b["a"], "b": b["b"], "c": c})[c >= least]

    measured = scratch.table(both.select("a", "b", "va", "vb").mapInPandas(exact, "a bigint, b bigint, c double"))
    # both ends may list the pair, also the one whose candidates it was not among
    ends = measured.select(F.col("a").alias("rid"), F.struct("c", F.col("b").alias("r")).alias("x")).unionByName(measured.select(F.col("b").alias("rid"), F.struct("c", F.col("a").alias("r")).alias("x")))
    ranked = ends.withColumn("o", F.row_number().over(Window.partitionBy("rid").orderBy(F.col("x.c").desc(), F.col("x.r").desc()))).where(F.col("o") <= k)
    return ranked.select("rid", F.col("x.r").alias("other"), F.col("x.c").alias("cosine"))


def neighbors(
    embedded: DataFrame, k: int = K, least: float = -1.1, trees: int = TREES, leaf: int = LEAF, probes: int = PROBES,
    sample: int = SAMPLE, dimension: int = DIMENSION, backend: str = "rp_forest", threshold: float = THRESHOLD,
) -> DataFrame:
    """claim_id_a, claim_id_b, cosine_similarity, candidate_rank, below_threshold, exact_match, retrieval_backend.

    For every claim its k most similar other claims among usable vectors, ranked by cosine, then
    id.  Claims with equal vectors share one search: equal claims come first as exact matches, each
    class giving its k + 1 smallest ids, which is all that a list of k can hold.  `least` drops
    lower cosines; an empty input gives an empty result.  Approximate: recall is measured by
    `recall_report`.
    """
    spark = embedded.sparkSession
    scratch = Scratch(spark, "neighbors")
    claims = scratch.table(usable_vectors(embedded, dimension))
    reps = scratch.table(claims.select("key", "vec").dropDuplicates(["key"]).withColumn("rid", F.monotonically_increasing_id()))
    near = similar_classes(reps, scratch, k, least, trees, leaf, probes, sample, dimension)
    byid = Window.partitionBy("key").orderBy("claim_id")
    firsts = scratch.table(
        claims.select("key", "claim_id").withColumn("o", F.row_number().over(byid)).where(F.col("o") <= k + 1)
        .join(reps.select("key", "rid"), "key").select("rid", "key", F.col("claim_id").alias("claim_id_b"))
    )
    others = near.join(firsts.select(F.col("rid").alias("other"), "claim_id_b"), "other").join(reps.select("rid", "key"), "rid").select("key", "claim_id_b", "cosine")
    copies = firsts.select("key", "claim_id_b", F.lit(1.0).alias("cosine"))
    offered = others.unionByName(copies)
    # a class needs no more than its k + 1 best offers, whichever of its claims asks
    order = Window.partitionBy("key").orderBy(F.col("cosine").desc(), "claim_id_b")
    offered = offered.withColumn("o", F.row_number().over(order)).where(F.col("o") <= k + 1)
    asked = claims.select("key", F.col("claim_id").alias("claim_id_a")).join(offered, "key").where("claim_id_a != claim_id_b")
    ranked = asked.withColumn("candidate_rank", F.row_number().over(Window.partitionBy("claim_id_a").orderBy(F.col("cosine").desc(), "claim_id_b"))).where(F.col("candidate_rank") <= k)
    return ranked.where(F.col("cosine") >= least).select(
        "claim_id_a", "claim_id_b", F.col("cosine").alias("cosine_similarity"), "candidate_rank",
        (F.col("cosine") < threshold).alias("below_threshold"), (F.col("cosine") > 1 - 1e-6).alias("exact_match"), F.lit(backend).alias("retrieval_backend"),
    )


def similar_pairs(embedded: DataFrame, threshold: float = THRESHOLD, k: int = K) -> DataFrame:
    """claim_id_a, claim_id_b (smaller first): pairs of at least `threshold`, one of which is among the k nearest of the other."""
    near = neighbors(embedded, k=k, least=threshold)
    return near.select(F.least("claim_id_a", "claim_id_b").alias("claim_id_a"), F.greatest("claim_id_a", "claim_id_b").alias("claim_id_b")).distinct()


def recall_report(embedded: DataFrame, k: int = K, queries: int = 500, threshold: float = THRESHOLD, dimension: int = DIMENSION) -> DataFrame:
    """One row: recall of `neighbors` against brute force, over `queries` claims drawn by hash, for all k and for cosines >= threshold.

    The queries, a fixed number, are compared with every vector in blocks; counted by cosine
    value, so that equal similarities are interchangeable.
    """
    spark = embedded.sparkSession
    scratch = Scratch(spark, "recall")
    claims = scratch.table(usable_vectors(embedded, dimension))
    asked = claims.orderBy(F.xxhash64(F.lit("recall"), "claim_id"), "claim_id").limit(queries).toPandas()
    names = asked["claim_id"].to_numpy()
    q = spark.sparkContext.broadcast(_matrix(asked["vec"], dimension).astype(np.float64))

    def brute(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b) or not len(names):
                continue
            s = q.value @ _matrix(b["vec"], dimension).astype(np.float64).T
            s[names[:, None] == b["claim_id"].to_numpy()[None, :]] = -2
            top = -np.sort(-s, axis=1)[:, :k]
            yield pd.DataFrame({"claim_id": np.repeat(names, top.shape[1]), "c": top.ravel()})

    exact = claims.mapInPandas(brute, "claim_id string, c double").where("c > -1.5")
    kth = exact.withColumn("o", F.row_number().over(Window.partitionBy("claim_id").orderBy(F.col("c").desc()))).where(F.col("o") <= k)
    want = kth.groupBy("claim_id").agg(F.min("c").alias("kth"), F.count("*").alias("n"), F.count_if(F.col("c") >= threshold).alias("n_similar"))
    got = neighbors(embedded, k=k, dimension=dimension).select(F.col("claim_id_a").alias("claim_id"), F.col("cosine_similarity").alias("c"))
    hits = want.join(got, "claim_id", "left").groupBy("claim_id", "n", "n_similar").agg(
        F.count_if(F.col("c") >= F.col("kth") - 1e-6).alias("hit"), F.count_if(F.col("c") >= threshold).alias("hit_similar")
    )
    return hits.agg(
        F.count("*").alias("n_queries"),
        F.round(F.sum(F.least("hit", "n")) / F.sum("n"), 4).alias("recall_at_k"),
        F.round(F.sum(F.least("hit_similar", "n_similar")) / F.sum("n_similar"), 4).alias("recall_similar"),
    )
