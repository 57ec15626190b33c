"""Queries over vectors and candidate pairs."""

from pyspark.sql import functions as F

from notegraph.functions import vectors as V
from notegraph.operators import similarity as S
from notegraph.plans import sql
from notegraph.plans.registry import query
from notegraph.session import table

TOPK = """(SELECT a, b, score, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS rank FROM (SELECT x.vec_id AS a, y.vec_id AS b, round(list_inner_product(x.embedding::DOUBLE[], y.embedding::DOUBLE[]), 9) AS score FROM embeddings x JOIN embeddings y ON x.vec_id <> y.vec_id))"""


def ranked(spark, d, k=10, threshold=0.30):
    return S.top_k_pairs(table(spark, d, "embeddings"), "vec_id", "embedding", k, threshold)


@query("j01_top_k", f"SELECT a, b, round(score, 6) AS score, rank::INTEGER AS rank FROM {TOPK} WHERE rank <= 10 AND score >= 0.3")
def j01(spark, d):
    return ranked(spark, d).select("a", "b", F.round("score", 6).alias("score"), "rank")


@query("j01_candidates", f"SELECT claim_id_a, claim_id_b, round(score, 6) AS score FROM (SELECT least(a, b) AS claim_id_a, greatest(a, b) AS claim_id_b, score, row_number() OVER (PARTITION BY least(a, b), greatest(a, b) ORDER BY a) AS o FROM {TOPK} WHERE rank <= 10 AND score >= 0.3) WHERE o = 1")
def j01c(spark, d):
    return S.candidates(ranked(spark, d)).select("claim_id_a", "claim_id_b", F.round("score", 6).alias("score"))


@query("w01_nearest_rank", f"SELECT a, b, rank::INTEGER AS rank FROM {TOPK} WHERE rank <= 3")
def w01(spark, d):
    return ranked(spark, d, 3, -2.0).select("a", "b", "rank")


@query("w03_density", "SELECT claim_id, n_neighbors, CASE WHEN n_neighbors > 20 THEN 'dense' WHEN n_neighbors <= 1 THEN 'isolated' ELSE 'normal' END AS density FROM (SELECT claim_id, count(*) FILTER (WHERE cosine_similarity >= 0.75) AS n_neighbors FROM (SELECT claim_id_a AS claim_id, cosine_similarity FROM p UNION ALL SELECT claim_id_b, cosine_similarity FROM p) GROUP BY 1)".replace("FROM p", "FROM (SELECT x AS claim_id_a, y AS claim_id_b, cosine_similarity FROM (SELECT least(claim_id_a, claim_id_b) AS x, greatest(claim_id_a, claim_id_b) AS y, cosine_similarity, row_number() OVER (PARTITION BY least(claim_id_a, claim_id_b), greatest(claim_id_a, claim_id_b) ORDER BY run_id, candidate_rank, cosine_similarity DESC NULLS LAST) AS o FROM candidate_pairs WHERE claim_id_a IS NOT NULL AND claim_id_b IS NOT NULL AND claim_id_a <> claim_id_b) WHERE o = 1)"))
def w03(spark, d):
    return S.density(S.unordered_pairs(table(spark, d, "candidate_pairs")))


@query("j02_rejections", """SELECT rejection_reason, count(*) AS n FROM (SELECT CASE WHEN claim_id_a = claim_id_b THEN 'self_pair' WHEN NOT ca OR NOT cb THEN 'missing_claim' WHEN NOT ea AND NOT eb THEN 'missing_embedding' WHEN coalesce(cosine_similarity < 0.75, true) THEN 'below_threshold' END AS rejection_reason
 FROM (SELECT *, claim_id_a IN (SELECT claim_id FROM claims) AS ca, coalesce(claim_id_b IN (SELECT claim_id FROM claims), false) AS cb, claim_id_a IN (SELECT claim_id FROM embedded_claims) AS ea, coalesce(claim_id_b IN (SELECT claim_id FROM embedded_claims), false) AS eb FROM candidate_pairs)) GROUP BY 1""")
def j02(spark, d):
    out = S.validate_pairs(table(spark, d, "candidate_pairs"), table(spark, d, "claims"), table(spark, d, "embedded_claims"))
    return out.groupBy("rejection_reason").agg(F.count("*").alias("n"))


@query("v01_payload", f"SELECT claim_id, CASE WHEN coalesce(context, '') <> '' THEN context || chr(10) ELSE '' END || coalesce(claim_text, '') AS payload FROM {sql.CLAIMS}")
def v01(spark, d):
    from notegraph.operators.records import distinct_claims

    return distinct_claims(table(spark, d, "claims")).select("claim_id", V.payload(F.col("context"), F.col("claim_text")).alias("payload"))


@query("v02_cache_key", f"SELECT claim_id, left(sha256(sha256(CASE WHEN coalesce(context, '') <> '' THEN context || chr(10) ELSE '' END || coalesce(claim_text, '')) || ':m1:c1'), 32) AS cache_key FROM {sql.CLAIMS}")
def v02(spark, d):
    from notegraph.operators.records import distinct_claims

    return distinct_claims(table(spark, d, "claims")).select("claim_id", V.cache_key(V.payload(F.col("context"), F.col("claim_text")), "m1", "c1").alias("cache_key"))


@query("v04_normalized", "SELECT vec_id, round(sqrt(list_sum(list_transform(u, lambda x: x * x))), 6) AS norm, round(u[1], 6) AS first FROM (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS u FROM embeddings)")
def v04(spark, d):
    u = table(spark, d, "embeddings").select("vec_id", V.l2_normalize(F.col("embedding")).alias("u"))
    return u.select("vec_id", F.round(V.norm(F.col("u")), 6).alias("norm"), F.round(F.element_at("u", 1), 6).alias("first"))


@query("v05_vector_problems", "SELECT problem, count(*) AS n FROM (SELECT CASE WHEN vector IS NULL THEN 'null' WHEN len(vector) <> 96 THEN 'dimension' WHEN len(list_filter(vector, lambda x: x IS NULL OR isnan(x) OR isinf(x))) > 0 THEN 'not_finite' WHEN len(list_filter(vector, lambda x: x <> 0)) = 0 THEN 'zero' END AS problem FROM embedded_claims) GROUP BY 1")
def v05(spark, d):
    return table(spark, d, "embedded_claims").groupBy(V.problem(F.col("vector"), 96).alias("problem")).agg(F.count("*").alias("n"))


@query("v07_cache_status", "SELECT CASE WHEN e.claim_id IS NULL THEN 'missing' WHEN cache_used THEN 'cached' ELSE 'computed' END AS status, count(*) AS n FROM (SELECT DISTINCT claim_id FROM claims) c FULL JOIN (SELECT claim_id, bool_or(cache_used) AS cache_used FROM embedded_claims GROUP BY 1) e USING (claim_id) GROUP BY 1")
def v07(spark, d):
    c = table(spark, d, "claims").select("claim_id").distinct()
    e = table(spark, d, "embedded_claims").groupBy("claim_id").agg(F.bool_or("cache_used").alias("cache_used")).withColumn("has", F.lit(True))
    status = F.when(F.col("has").isNull(), "missing").when(F.col("cache_used"), "cached").otherwise("computed")
    return c.join(e, "claim_id", "full").groupBy(status.alias("status")).agg(F.count("*").alias("n"))


@query("v06_quality_flags", "SELECT dimension_ok, normalized, finite, cache_used, count(*) AS n FROM (SELECT coalesce(len(vector) = 96, false) AS dimension_ok, coalesce(f, false) AS finite, coalesce(f AND abs(sqrt(list_sum(list_transform(vector::DOUBLE[], lambda x: x * x))) - 1) <= 1e-3, false) AS normalized, coalesce(cache_used, false) AS cache_used FROM (SELECT *, len(list_filter(vector, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AS f FROM embedded_claims)) GROUP BY 1, 2, 3, 4")
def v06(spark, d):
    return table(spark, d, "embedded_claims").select(V.quality(F.col("vector"), 96, F.col("cache_used")).alias("q")).groupBy("q.dimension_ok", "q.normalized", "q.finite", "q.cache_used").agg(F.count("*").alias("n"))


@query("v07_cache_lookup", "SELECT CASE WHEN e.claim_id IS NULL THEN 'failed' WHEN dimension <> 96 THEN 'stale' WHEN v IS NULL THEN 'failed' ELSE 'cached' END AS status, count(*) AS n FROM (SELECT DISTINCT claim_id FROM (SELECT claim_id FROM claims UNION ALL SELECT claim_id FROM embedded_claims)) c LEFT JOIN (SELECT claim_id, arg_max(dimension, embedded_at) AS dimension, max(CASE WHEN vector IS NOT NULL THEN 1 END) AS v FROM embedded_claims GROUP BY 1) e USING (claim_id) WHERE c.claim_id IS NOT NULL GROUP BY 1")
def v07l(spark, d):
    # the dimension stands for the configuration that a cached vector was made with
    e = table(spark, d, "embedded_claims").where("claim_id is not null")
    held = e.groupBy("claim_id").agg(F.max_by("dimension", "embedded_at").cast("string").alias("config"), F.max(F.when(F.col("vector").isNotNull(), 1)).alias("vector")).withColumns({"found": F.lit(True), "schema": F.lit("1"), "model": F.lit("m")})
    ids = table(spark, d, "claims").select("claim_id").unionByName(e.select("claim_id")).where("claim_id is not null").distinct()
    status = V.cache_status(*[F.col(c) for c in ("found", "schema", "model", "config", "vector")], ("1", "m", "96"))
    return ids.join(held, "claim_id", "left").groupBy(status.alias("status")).agg(F.count("*").alias("n"))


@query("a29_recall_sweep", f"""SELECT k::INTEGER AS k, t AS threshold, round(count(g.a)::DOUBLE / (SELECT count(*) FROM g), 6) AS recall, round(count(c.a)::DOUBLE / (SELECT count(*) FROM embeddings), 6) AS candidates_per_query FROM
 (SELECT unnest([5, 10]) AS k) CROSS JOIN (SELECT unnest([0.25, 0.3, 0.35]::DOUBLE[]) AS t) LEFT JOIN (SELECT DISTINCT k AS ck, t AS ct, least(a, b) AS a, greatest(a, b) AS b FROM {TOPK} CROSS JOIN (SELECT unnest([5, 10]) AS k) CROSS JOIN (SELECT unnest([0.25, 0.3, 0.35]::DOUBLE[]) AS t) WHERE rank <= k AND score >= t) c ON ck = k AND ct = t LEFT JOIN g ON g.a = c.a AND g.b = c.b GROUP BY 1, 2""".replace("FROM g)", "FROM (SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM T WHERE rank <= 1))").replace("LEFT JOIN g ON", "LEFT JOIN (SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM T WHERE rank <= 1) g ON").replace("FROM T", f"FROM {TOPK}"))
def a29(spark, d):
    from notegraph.lineage import Scratch

    r = Scratch(spark, "recall").table(ranked(spark, d, 10, -2.0))
    n = table(spark, d, "embeddings").count()
    return S.recall_sweep(r, r.where("rank <= 1").select("a", "b"), (5, 10), (0.25, 0.3, 0.35), n)
