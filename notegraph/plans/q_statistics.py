"""Queries of aggregate statistics."""

from pyspark.sql import functions as F

from notegraph.operators import evaluation as E
from notegraph.operators import relations as R
from notegraph.operators import statistics as A
from notegraph.plans import sql
from notegraph.plans.base import typed
from notegraph.plans.q_engine import record_query
from notegraph.plans.registry import query
from notegraph.session import table


@record_query("a01_overview", f"SELECT count(*) AS n_claims, round(avg(reliability_index), 2) AS mean_reliability, round(median(reliability_index), 2) AS median_reliability, count(*) FILTER (WHERE reliability_index >= 65) AS n_high, count(*) FILTER (WHERE reliability_index < 45) AS n_low, round(avg(uncertainty_score), 2) AS mean_uncertainty FROM {sql.RECORDS}")
def a01(spark, d, rows):
    return A.overview(rows)


@record_query("a02_labels", f"SELECT calibration_label, count(*) AS n FROM {sql.RECORDS} GROUP BY 1")
def a02(spark, d, rows):
    return rows.groupBy("calibration_label").agg(F.count("*").alias("n"))


@record_query("a03_histogram", f"SELECT b::INTEGER AS bucket, CAST(b * 10 AS VARCHAR) || '-' || CAST((b + 1) * 10 AS VARCHAR) AS label, count(r.claim_id) AS n FROM generate_series(0, 9) s(b) LEFT JOIN {sql.RECORDS} r ON least(floor(reliability_index / 10), 9) = b GROUP BY b")
def a03(spark, d, rows):
    return A.histogram(rows, F.col("reliability_index"))


@record_query("a04_partition_summary", f"SELECT partition_id, count(*) AS n_nodes, round(avg(reliability_index), 4) AS mean_reliability, round(avg(uncertainty_score), 4) AS mean_uncertainty, sum(support_count)::BIGINT AS n_supports, count(*) FILTER (WHERE is_hub) AS n_hubs, count(*) FILTER (WHERE is_bridge) AS n_bridges FROM {sql.RECORDS} GROUP BY 1")
def a04p(spark, d, rows):
    return A.partition_summary(rows)


@record_query("a04_document_summary", f"SELECT document_id, count(*) AS n_claims, round(avg(reliability_index), 6) AS mean_reliability, sum(support_count)::BIGINT AS n_supports FROM {sql.RECORDS} GROUP BY 1")
def a04(spark, d, rows):
    return rows.groupBy("document_id").agg(F.count("*").alias("n_claims"), F.round(F.avg("reliability_index"), 6).alias("mean_reliability"), F.sum("support_count").alias("n_supports"))


@record_query("a06_scoring_maxima", f"SELECT greatest(1, max(support_count)) AS max_support, round(avg(support_count), 6) AS avg_support, max(in_degree) AS max_in_degree, max(degree) AS max_degree FROM {sql.RECORDS}")
def a06(spark, d, rows):
    return rows.agg(F.greatest(F.lit(1), F.max("support_count")).alias("max_support"), F.round(F.avg("support_count"), 6).alias("avg_support"), F.max("in_degree").alias("max_in_degree"), F.max("degree").alias("max_degree"))


@query("a10_embedding_statistics", "SELECT count(*) AS n, count(DISTINCT claim_id) AS n_claims, count(*) FILTER (WHERE cache_used) AS n_cached, round(avg(CASE WHEN cache_used THEN 1.0 ELSE 0.0 END::DOUBLE), 6) AS hit_rate, count(*) FILTER (WHERE NOT finite) AS n_not_finite FROM embedded_claims")
def a10(spark, d):
    e = table(spark, d, "embedded_claims")
    return e.agg(F.count("*").alias("n"), F.count_distinct("claim_id").alias("n_claims"), F.count_if("cache_used").alias("n_cached"), F.round(F.avg(F.coalesce(F.col("cache_used"), F.lit(False)).cast("double")), 6).alias("hit_rate"), F.count_if(~F.col("finite")).alias("n_not_finite"))


@query("a11_confidence_histogram", f"SELECT least(floor(decision_confidence * 10), 9)::INTEGER AS bin, relation_type, count(*) AS n FROM {sql.EDGES} GROUP BY 1, 2")
def a11(spark, d):
    e = typed(spark, d)
    return e.groupBy(F.least(F.floor(F.col("decision_confidence") * 10), F.lit(9)).cast("int").alias("bin"), "relation_type").agg(F.count("*").alias("n"))


@record_query("a12_telemetry", f"SELECT round(avg(reliability_index), 6) AS avg_index, round(avg(uncertainty_score), 6) AS avg_uncertainty, count(*) FILTER (WHERE calibration_label IN ('high', 'very_high')) AS n_high, count(*) FILTER (WHERE calibration_label IN ('low', 'very_low')) AS n_low FROM {sql.RECORDS}")
def a12(spark, d, rows):
    x = F.col("calibration_label")
    return rows.agg(F.round(F.avg("reliability_index"), 6).alias("avg_index"), F.round(F.avg("uncertainty_score"), 6).alias("avg_uncertainty"), F.count_if(x.isin("high", "very_high")).alias("n_high"), F.count_if(x.isin("low", "very_low")).alias("n_low"))


@query("a13_index_statistics", " UNION ALL ".join(f"SELECT '{f}' AS field, count(DISTINCT {f}) AS n_values, count({f}) AS n_entries, round(count({f})::DOUBLE / greatest(1, count(DISTINCT {f})), 6) AS entries_per_value FROM {sql.CLAIMS}" for f in ("document_id", "modality", "extraction_mode")))
def a13(spark, d):
    from notegraph.operators.records import distinct_claims

    return A.index_statistics(distinct_claims(table(spark, d, "claims")), ["document_id", "modality", "extraction_mode"])


T = "CASE WHEN n < 5 THEN 2.571 WHEN n < 30 THEN 2.045 ELSE 1.96 END::DOUBLE"


@query("a22_group_summary", f"SELECT model_name, n, round(m, 6) AS mean, round(s, 6) AS sd, round(md, 6) AS median, round(lo, 6) AS least, round(hi, 6) AS most, round(CASE WHEN abs(m) > 1e-12 THEN s / abs(m) ELSE 0.0 END, 6) AS cv, round(m - {T} * s / sqrt(n), 6) AS ci_low, round(m + {T} * s / sqrt(n), 6) AS ci_high FROM (SELECT model_name, count(*) AS n, avg(conf_ab) AS m, coalesce(stddev_samp(conf_ab), 0) AS s, median(conf_ab) AS md, min(conf_ab) AS lo, max(conf_ab) AS hi FROM {sql.FLAT} GROUP BY 1)")
def a22(spark, d):
    return A.group_summary(R.flat_evidence(table(spark, d, "relationship_evidence")), "model_name", "conf_ab")


@query("a23_effect_size", f"SELECT round(dd, 6) AS cohens_d, CASE WHEN abs(dd) < 0.2 THEN 'negligible' WHEN abs(dd) < 0.5 THEN 'small' WHEN abs(dd) < 0.8 THEN 'medium' ELSE 'large' END AS magnitude FROM (SELECT (avg(conf_ab) FILTER (WHERE model_name = 'nli-small') - avg(conf_ab) FILTER (WHERE model_name = 'nli-base')) / sqrt(((count(*) FILTER (WHERE model_name = 'nli-small') - 1) * var_samp(conf_ab) FILTER (WHERE model_name = 'nli-small') + (count(*) FILTER (WHERE model_name = 'nli-base') - 1) * var_samp(conf_ab) FILTER (WHERE model_name = 'nli-base')) / (count(*) FILTER (WHERE model_name IN ('nli-small', 'nli-base')) - 2)) AS dd FROM {sql.FLAT})")
def a23(spark, d):
    return A.effect_size(R.flat_evidence(table(spark, d, "relationship_evidence")), "model_name", "nli-small", "nli-base", "conf_ab")


@query("a24_reproducibility", f"SELECT claim_id_a, CASE WHEN cv < 0.05 THEN 'excellent' WHEN cv < 0.1 THEN 'good' WHEN cv < 0.2 THEN 'acceptable' ELSE 'poor' END AS grade FROM (SELECT claim_id_a, stddev_samp(conf_ab) / avg(conf_ab) AS cv FROM {sql.FLAT} GROUP BY 1 HAVING count(*) > 1)")
def a24(spark, d):
    r = R.flat_evidence(table(spark, d, "relationship_evidence")).groupBy("claim_id_a").agg(F.count("*").alias("n"), (F.stddev_samp("conf_ab") / F.avg("conf_ab")).alias("cv")).where("n > 1")
    return r.select("claim_id_a", A.reproducibility(F.col("cv")).alias("grade"))


@query("a26_pearson", f"SELECT round(corr(conf_ab, cosine_similarity), 6) AS r FROM {sql.FLAT}")
def a26(spark, d):
    return E.pearson(R.flat_evidence(table(spark, d, "relationship_evidence")), "conf_ab", "cosine_similarity")


@query("a38_latency", "SELECT event_type, max(n) AS n, max(CASE WHEN r = least(floor(n * 0.5), n - 1) THEN x END) AS p50, max(CASE WHEN r = least(floor(n * 0.95), n - 1) THEN x END) AS p95, max(CASE WHEN r = least(floor(n * 0.99), n - 1) THEN x END) AS p99 FROM (SELECT event_type, value AS x, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL) GROUP BY 1")
def a38(spark, d):
    return A.latency(table(spark, d, "events"), "event_type", "value")


@query("a42_label_counts", "SELECT pass, upper(trim(label)) AS label, count(*) AS n FROM (SELECT 1 AS pass, label FROM pass1_relationships UNION ALL SELECT 2, label FROM pass2_relationships) GROUP BY 1, 2")
def a42(spark, d):
    both = [table(spark, d, f"pass{i}_relationships").select(F.lit(i).alias("pass"), "label") for i in (1, 2)]
    return both[0].unionByName(both[1]).groupBy("pass", F.upper(F.trim("label")).alias("label")).agg(F.count("*").alias("n"))


@query("st_event_windows", "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(avg(value), 6) AS mean_value FROM events GROUP BY 1, 2")
def st01(spark, d):
    from notegraph.streaming.incremental import event_windows

    w = event_windows(table(spark, d, "events"))
    return w.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))
