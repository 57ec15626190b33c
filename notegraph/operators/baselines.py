"""Lexical baselines and corpus checks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from notegraph.functions import lexicon
from notegraph.lineage import Scratch


def tfidf_vectors(texts: DataFrame) -> DataFrame:
    """claim_id, w, x: tf times smoothed idf, divided by the text's length; texts: (claim_id, text), null counts as empty."""
    words = texts.select("claim_id", F.explode(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("([a-z0-9][a-z0-9]+)"))).alias("w"))
    tf = words.groupBy("claim_id", "w").agg(F.count("*").cast("double").alias("tf"))
    n = texts.count()
    idf = tf.groupBy("w").agg((F.log((1 + F.lit(float(n))) / (1 + F.count("*"))) + 1).alias("idf"))
    v = tf.join(idf, "w").select("claim_id", "w", (F.col("tf") * F.col("idf")).alias("x"))
    length = v.groupBy("claim_id").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("len"))
    return v.join(length, "claim_id").select("claim_id", "w", (F.col("x") / F.col("len")).alias("x"))


def tfidf_similarity(texts: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """claim_id_a, claim_id_b, similarity of the given pairs at or above the threshold; every text's vector is used whole.

    Each pair brings its own words, so no word's posting list is joined with itself.
    """
    v = tfidf_vectors(texts)
    a = v.select(F.col("claim_id").alias("claim_id_a"), "w", F.col("x").alias("xa"))
    b = v.select(F.col("claim_id").alias("claim_id_b"), "w", F.col("x").alias("xb"))
    dots = pairs.join(a, "claim_id_a").join(b, ["claim_id_b", "w"]).groupBy("claim_id_a", "claim_id_b").agg(F.sum(F.col("xa") * F.col("xb")).alias("s"))
    return dots.where(F.col("s") >= threshold).select("claim_id_a", "claim_id_b", F.round("s", 6).alias("similarity"))


def lint(manifest: DataFrame) -> DataFrame:
    """issue, n: missing second texts, texts without final mark, families in several splits, repeated pairs."""
    family = F.lower(F.trim("template_family_id"))
    one = lambda df, name: df.select(F.lit(name).alias("issue"))
    split = manifest.where(family != "").groupBy(family.alias("f")).agg(F.count_distinct(F.lower(F.trim("split"))).alias("n")).where("n > 1")
    twice = manifest.groupBy("text_a", "text_b").agg(F.count("*").alias("n")).where("n > 1")
    found = (
        one(manifest.where("text_b is null"), "missing_text_b").unionByName(one(manifest.where(~F.col("text_a").rlike(r"[.!?…]\s*$")), "no_final_mark"))
        .unionByName(one(split, "family_in_several_splits")).unionByName(one(twice, "duplicate_pair"))
    )
    return found.groupBy("issue").agg(F.count("*").alias("n"))


def placed(rows: DataFrame, block: int) -> DataFrame:
    """at and one list per column of rows: the rows hashed by claim_id into n / block blocks, n being all of them."""
    blocks = max(1, -(-rows.count() // block))
    lists = rows.groupBy(F.pmod(F.xxhash64("claim_id"), F.lit(blocks)).cast("int").alias("at")).agg(F.collect_list(F.struct(*rows.columns)).alias("r"))
    return lists.select("at", *[F.col(f"r.{n}").alias(n) for n in rows.columns])


def labelled_pairs(packed: DataFrame, product: Callable[[dict, dict], np.ndarray], candidate: float, support: float, held: int = 1 << 22) -> DataFrame:
    """claim_id_a, claim_id_b (smaller first), similarity, label: every pair of claims whose product reaches `candidate`.

    packed: a written table with a row per block of claims, whose columns at, claim_id, neg and others are lists but for the
    first; product gets the other columns of two blocks as Arrow arrays.  Every two blocks meet once in a join that reads these
    rows again and copies nothing, so the disk taken follows the claims and not their square.  One-sided negation contradicts, a product of `support` supports, else neutral.

    The rows are the larger part, so they come in an order that files store in little room: a task meets a tile of up to some 8 x 8 blocks,
    whose ids are few enough for a dictionary, and gives its rows by similarity, up to some `held` of them at a time, so that equal ones stand together.
    """
    n = packed.count()
    tiles = packed.repartitionByRange(max(1, -(-n // 8), min(-(-n // 2), 12)), "at")
    left, right = (tiles.select(*[F.col(x).alias(f"{x}_{side}") for x in packed.columns]) for side in "ab")
    met = left.join(right.hint("shuffle_replicate_nl"), F.col("at_a") <= F.col("at_b"))
    names = packed.columns[1:]

    def meet(same: bool, a: dict, b: dict) -> tuple[np.ndarray, ...]:
        """Of each hit whether the id of a is the smaller, its rows in a and b, product and label."""
        s = product(a, b)
        hit = s >= candidate
        at = np.flatnonzero(np.triu(hit, 1) if same else hit)
        high, wide = len(a["claim_id"]), len(b["claim_id"])
        rank = np.empty(high + wide, np.int64)
        rank[pc.array_sort_indices(pa.concat_arrays([a["claim_id"], b["claim_id"]])).to_numpy()] = np.arange(high + wide)
        p, q, sim = (at // wide).astype(np.int32), (at % wide).astype(np.int32), s.ravel()[at]
        differ = a["neg"].to_numpy(zero_copy_only=False)[p] != b["neg"].to_numpy(zero_copy_only=False)[q]
        return rank[p] < rank[q + high], p, q, sim, np.where(differ, 0, np.where(sim >= support, 1, 2)).astype(np.int8)

    def ordered(ids: pa.Array, rows: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        if not rows:
            return
        smaller, larger, sim, label = (np.concatenate(x) for x in zip(*rows, strict=True))
        rows.clear()
        texts, order = pa.array(["CONTRADICTS", "SUPPORTS", "NEUTRAL"]), np.argsort(sim)
        for low in range(0, len(order), 1 << 17):
            at = order[low : low + (1 << 17)]
            columns = [ids.take(pa.array(smaller[at])), ids.take(pa.array(larger[at])), pa.array(sim[at]), texts.take(pa.array(label[at]))]
            yield pa.RecordBatch.from_arrays(columns, ["claim_id_a", "claim_id_b", "similarity", "label"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts: dict[int, int] = {}
        pool: list[pa.Array] = []
        rows: list[tuple[np.ndarray, ...]] = []
        for g in batches:
            for r in range(g.num_rows):
                a, b = ({x: g.column(f"{x}_{side}")[r].values for x in names} for side in "ab")
                blocks = [(g.column(f"at_{side}")[r].as_py(), x["claim_id"]) for side, x in (("a", a), ("b", b))]
                for at, ids in blocks:
                    if at not in starts:
                        starts[at] = sum(map(len, pool))
                        pool.append(ids)
                (i, _), (j, _) = blocks
                first, p, q, sim, label = meet(i == j, a, b)
                p, q = p + np.int32(starts[i]), q + np.int32(starts[j])
                rows.append((np.where(first, p, q), np.where(first, q, p), np.round(sim, 6), label))
                if sum(len(x[0]) for x in rows) >= held:
                    yield from ordered(pa.concat_arrays(pool), rows)
        if pool:
            yield from ordered(pa.concat_arrays(pool), rows)

    return met.mapInArrow(run, "claim_id_a string, claim_id_b string, similarity double, label string")


def tfidf_blocks(texts: DataFrame, block: int) -> DataFrame:
    """A written table of blocks of claims with any word: at, claim_id, neg, then of each word in the block n claims, key, idf, and per word and claim row, tf.

    The entries of row and tf follow the words, n to each.  key is the same number for a word in all blocks.  Words are shuffled once
    a block and not once a claim; weights are left to the product, as idf and tf take less room.
    """
    scratch = Scratch(texts.sparkSession, "pairs")
    words = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("([a-z0-9][a-z0-9]+)"))
    rows = scratch.table(texts.select("claim_id", lexicon.has_negation_cue(F.col("text")).alias("neg"), words.alias("w")))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in batches:
            for r in range(g.num_rows):
                claim_id, neg, w = (g.column(n)[r].values for n in ("claim_id", "neg", "w"))
                coded = w.flatten().dictionary_encode()
                at = np.repeat(np.arange(len(w)), pc.list_value_length(w).to_numpy())
                entry, tf = np.unique(coded.indices.to_numpy().astype(np.int64) * len(w) + at, return_counts=True)
                n = np.bincount(entry // len(w), minlength=len(coded.dictionary))
                columns = [claim_id, neg, pa.array((entry % len(w)).astype(np.int32)), pa.array(tf.astype(np.int32)), pa.array(n.astype(np.int32)), coded.dictionary]
                lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in columns]
                yield pa.RecordBatch.from_arrays([g.column("at").slice(r, 1), *lists], ["at", "claim_id", "neg", "row", "tf", "n", "w"])

    some = placed(rows, block).select("at", F.filter(F.arrays_zip("claim_id", "neg", "w"), lambda x: F.size(x["w"]) > 0).alias("r")).where("size(r) > 0")
    blocks = scratch.table(some.select("at", "r.claim_id", "r.neg", "r.w").mapInArrow(number, "at int, claim_id array<string>, neg array<boolean>, row array<int>, tf array<int>, n array<int>, w array<string>"))
    word, total = Window.partitionBy("w"), F.lit(float(rows.count()))
    each = blocks.select("at", F.posexplode(F.arrays_zip("w", "n")).alias("pos", "e")).select("at", "pos", "e.w", "e.n")
    found = each.select("at", F.struct("pos", F.min(F.col("at") * F.lit(1 << 32) + F.col("pos")).over(word).alias("key"), (F.log((1 + total) / (1 + F.sum("n").over(word))) + 1).alias("idf")).alias("v"))
    listed = found.groupBy("at").agg(F.array_sort(F.collect_list("v")).alias("v"))
    packed = scratch.table(blocks.join(listed, "at").select("at", "claim_id", "neg", "row", "tf", "n", "v.key", "v.idf"))
    scratch.drop(rows, blocks)
    return packed


def entries(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1 and so on, n[0] of them, then those of start[1]."""
    return np.repeat(start - np.cumsum(n) + n, n) + np.arange(n.sum())


def tfidf_product(a: dict, b: dict) -> np.ndarray:
    """Cosines of two blocks of tfidf_blocks: words in many claims of both as matrices, the others claim by claim."""

    def weighed(g: dict) -> tuple[np.ndarray, ...]:
        row, tf, n, key, idf = (g[x].to_numpy() for x in ("row", "tf", "n", "key", "idf"))
        x = tf * np.repeat(idf, n)
        return key, n.astype(np.int64), np.cumsum(n, dtype=np.int64) - n, row.astype(np.int64), x / np.sqrt(np.bincount(row, x * x))[row]

    (ka, na, sa, ra, xa), (kb, nb, sb, rb, xb) = weighed(a), weighed(b)
    high, wide = len(a["claim_id"]), len(b["claim_id"])
    _, ia, ib = np.intersect1d(ka, kb, assume_unique=True, return_indices=True)
    na, sa, nb, sb = na[ia], sa[ia], nb[ib], sb[ib]
    often = na * nb * 512 >= high * wide

    def dense(start: np.ndarray, n: np.ndarray, row: np.ndarray, x: np.ndarray, rows: int) -> np.ndarray:
        out, at = np.zeros((rows, len(n))), entries(start, n)
        out[row[at], np.repeat(np.arange(len(n)), n)] = x[at]
        return out

    def together(w: np.ndarray) -> np.ndarray:
        return dense(sa[w], na[w], ra, xa, high) @ dense(sb[w], nb[w], rb, xb, wide).T

    which = np.flatnonzero(often)
    s = together(which[:1024])
    for low in range(1024, len(which), 1024):
        s += together(which[low : low + 1024])
    rare = ~often
    ea, times, start = entries(sa[rare], na[rare]), np.repeat(nb[rare], na[rare]), np.repeat(sb[rare], na[rare])
    upto = np.cumsum(times)
    low = 0
    while low < len(ea):
        top = max(low + 1, int(np.searchsorted(upto, (upto[low - 1] if low else 0) + (1 << 22), "right")))
        e, t, eb = ea[low:top], times[low:top], entries(start[low:top], times[low:top])
        np.add.at(s.ravel(), np.repeat(ra[e] * wide, t) + rb[eb], np.repeat(xa[e], t) * xb[eb])
        low = top
    return s


def vector_product(a: dict, b: dict) -> np.ndarray:
    """Inner products of two blocks of vectors of one length."""
    x, y = (g["x"].flatten().to_numpy().reshape(len(g["x"]), -1) for g in (a, b))
    return x @ y.T


def tfidf_relations(texts: DataFrame, candidate: float = 0.20, support: float = 0.55, block: int = 2048) -> DataFrame:
    """The TF-IDF baseline over all pairs of texts: (claim_id, text)."""
    return labelled_pairs(tfidf_blocks(texts, block), tfidf_product, candidate, support)


def vector_relations(texts: DataFrame, vectors: DataFrame, candidate: float = 0.45, support: float = 0.75, block: int = 2048) -> DataFrame:
    """The sentence-vector baseline over all pairs; vectors: (claim_id, vector), unit vectors of one length."""
    scratch = Scratch(vectors.sparkSession, "pairs")
    rows = scratch.table(vectors.join(texts.select("claim_id", lexicon.has_negation_cue(F.col("text")).alias("neg")), "claim_id").select("claim_id", "neg", F.col("vector").cast("array<double>").alias("x")))
    packed = scratch.table(placed(rows, block))
    scratch.drop(rows)
    return labelled_pairs(packed, vector_product, candidate, support)
