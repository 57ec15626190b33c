"""Aggregations: graph-wide statistics, histograms, telemetry, latency, statistical summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notegraph.lineage import Scratch
from notegraph.operators.ranking import values_at


def overview(records: DataFrame) -> DataFrame:
    """One row: count, mean, interpolated median, counts of indices >= 65 and < 45, mean uncertainty."""
    x = F.col("reliability_index")
    return records.agg(
        F.count("*").alias("n_claims"), F.round(F.avg(x), 2).alias("mean_reliability"), F.round(F.percentile(x, F.lit(0.5)), 2).alias("median_reliability"),
        F.count_if(x >= 65).alias("n_high"), F.count_if(x < 45).alias("n_low"), F.round(F.avg("uncertainty_score"), 2).alias("mean_uncertainty"),
    )


def histogram(rows: DataFrame, value: Column, buckets: int = 10, width: float = 10.0) -> DataFrame:
    """bucket, label "a-b", n for every bucket, empty ones included; the last bucket is closed."""
    spark = rows.sparkSession
    at = F.least(F.floor(value / width), F.lit(buckets - 1)).cast("int")
    n = rows.where(value.isNotNull()).groupBy(at.alias("bucket")).agg(F.count("*").alias("n"))
    grid = spark.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    label = F.concat((F.col("bucket") * F.lit(width)).cast("int").cast("string"), F.lit("-"), ((F.col("bucket") + 1) * F.lit(width)).cast("int").cast("string"))
    return grid.join(n, "bucket", "left").select("bucket", label.alias("label"), F.coalesce("n", F.lit(0)).alias("n"))


def group_summary(rows: DataFrame, group: str, value: str) -> DataFrame:
    """group, n, mean, sd (sample), median, min, max, cv and the confidence interval with t 2.571 below 5 values, 2.045 below 30, else 1.96."""
    x = F.col(value)
    s = rows.where(x.isNotNull()).groupBy(group).agg(F.count("*").alias("n"), F.avg(x).alias("m"), F.coalesce(F.stddev_samp(x), F.lit(0.0)).alias("s"), F.percentile(x, F.lit(0.5)).alias("md"), F.min(x).alias("lo"), F.max(x).alias("hi"))
    t = F.when(F.col("n") < 5, 2.571).when(F.col("n") < 30, 2.045).otherwise(1.96)
    half = t * F.col("s") / F.sqrt("n")
    cv = F.when(F.abs("m") > 1e-12, F.col("s") / F.abs("m")).otherwise(0.0)
    return s.select(group, "n", *[F.round(c, 6).alias(a) for c, a in ((F.col("m"), "mean"), (F.col("s"), "sd"), (F.col("md"), "median"), (F.col("lo"), "least"), (F.col("hi"), "most"), (cv, "cv"), (F.col("m") - half, "ci_low"), (F.col("m") + half, "ci_high"))])


def effect_size(rows: DataFrame, group: str, a: str, b: str, value: str) -> DataFrame:
    """One row: Cohen's d of group a over b with pooled deviation, and its magnitude."""
    x = rows.where(F.col(value).isNotNull())
    one = lambda g, n: x.where(F.col(group) == g).agg(F.count("*").alias(f"n{n}"), F.avg(value).alias(f"m{n}"), F.coalesce(F.var_samp(value), F.lit(0.0)).alias(f"v{n}"))
    j = one(a, "a").crossJoin(one(b, "b"))  # one row each
    pooled = F.sqrt(((F.col("na") - 1) * F.col("va") + (F.col("nb") - 1) * F.col("vb")) / F.greatest(F.lit(1), F.col("na") + F.col("nb") - 2))
    d = F.when(pooled > 0, (F.col("ma") - F.col("mb")) / pooled).otherwise(0.0)
    return j.select(F.round(d, 6).alias("cohens_d"), F.when(F.abs(d) < 0.2, "negligible").when(F.abs(d) < 0.5, "small").when(F.abs(d) < 0.8, "medium").otherwise("large").alias("magnitude"))


def reproducibility(cv: Column) -> Column:
    return F.when(cv < 0.05, "excellent").when(cv < 0.10, "good").when(cv < 0.20, "acceptable").otherwise("poor")


def latency(rows: DataFrame, group: str, value: str) -> DataFrame:
    """group, n, p50, p95, p99: the value of rank int(n p) (from 0) in ascending order, found in ranges of the values."""
    return values_at(rows, group, value, {"p50": 0.50, "p95": 0.95, "p99": 0.99}, Scratch(rows.sparkSession, "latency"))


def index_statistics(rows: DataFrame, fields: list[str]) -> DataFrame:
    """field, n_values, n_entries, entries_per_value of every field, in one pass."""
    s = rows.agg(*[F.count_distinct(f).alias(f"d_{f}") for f in fields], *[F.count(f).alias(f"n_{f}") for f in fields])
    return s.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"d_{f}").alias("n_values"), F.col(f"n_{f}").alias("n_entries")) for f in fields])).alias("x")).select(
        "x.field", "x.n_values", "x.n_entries", F.round(F.col("x.n_entries") / F.greatest(F.lit(1), F.col("x.n_values")), 6).alias("entries_per_value")
    )


def partition_summary(records: DataFrame) -> DataFrame:
    """partition_id, n_nodes, mean_reliability, mean_uncertainty, n_supports, n_hubs, n_bridges: one partial aggregate."""
    return records.groupBy("partition_id").agg(
        F.count("*").alias("n_nodes"), F.round(F.avg("reliability_index"), 4).alias("mean_reliability"), F.round(F.avg("uncertainty_score"), 4).alias("mean_uncertainty"),
        F.sum("support_count").alias("n_supports"), F.count_if("is_hub").alias("n_hubs"), F.count_if("is_bridge").alias("n_bridges"),
    )
