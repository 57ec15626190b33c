"""Exact ranks without ordering a whole table, or a whole group, in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notegraph.lineage import Scratch

SLICE, BEFORE, IN_GROUP = "slice_", "before_", "n_group_"


def sliced(rows: DataFrame, groups: list[str], order: list[Column], scratch: Scratch, sums: dict[str, Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows with slice_, counts): the rows cut into ranges of (groups, order), of which a hot group or value takes several.

    counts: groups, slice_, n, before_ (rows of the group in earlier slices), n_group_ and, for every
    entry of `sums`, its sum in earlier slices; one row per group and slice.  `order` must be total, so that
    equal values do not end up in one range.  The rank of a row is before_ plus its rank in its slice.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = scratch.table(rows.repartitionByRange(parts, *[F.col(g) for g in groups], *order).withColumn(SLICE, F.spark_partition_id()))
    sums = sums or {}
    per = placed.groupBy(*groups, SLICE).agg(F.count("*").alias("n"), *[F.sum(c).alias(f"sum_{k}") for k, c in sums.items()])
    # without groups one row per slice, else one per group and slice
    w = Window.partitionBy(*[F.col(g) for g in groups]) if groups else Window.partitionBy(F.lit(0))
    up = w.orderBy(SLICE)
    return placed, per.select(
        *groups, SLICE, "n", (F.sum("n").over(up) - F.col("n")).alias(BEFORE), F.sum("n").over(w).alias(IN_GROUP),
        *[(F.sum(f"sum_{k}").over(up) - F.col(f"sum_{k}")).alias(k) for k in sums],
    )


def values_at(rows: DataFrame, group: str, value: str, shares: dict[str, float], scratch: Scratch) -> DataFrame:
    """group, n and, for every name in `shares`, the value of rank int(n share) (from 0, at most n - 1) in ascending order."""
    kept = rows.where(F.col(value).isNotNull()).select(F.col(group).alias("g"), F.col(value).alias("x"))
    # equal values are interchangeable; a number per row makes the order total
    kept = kept.withColumn("u", F.monotonically_increasing_id())
    placed, counts = sliced(kept, ["g"], [F.col("x"), F.col("u")], scratch)
    wanted = F.explode(F.array(*[F.struct(F.lit(k).alias("name"), F.least(F.floor(F.col(IN_GROUP) * s), F.col(IN_GROUP) - 1).alias("t")) for k, s in shares.items()]))
    hit = counts.select("g", SLICE, BEFORE, IN_GROUP, "n", wanted.alias("w")).where((F.col("w.t") >= F.col(BEFORE)) & (F.col("w.t") < F.col(BEFORE) + F.col("n")))
    hit = scratch.table(hit.select("g", SLICE, IN_GROUP, "w.name", (F.col("w.t") - F.col(BEFORE)).alias("at")))
    near = placed.alias("p").join(hit.select("g", SLICE).distinct().withColumnRenamed("g", "g2").alias("h"), F.expr("p.g <=> h.g2 and p.slice_ = h.slice_"), "left_semi")
    ranked = near.select("g", SLICE, "x", (F.row_number().over(Window.partitionBy("g", SLICE).orderBy("x", "u")) - 1).alias("at"))
    found = hit.alias("h").join(ranked.alias("r"), F.expr("h.g <=> r.g and h.slice_ = r.slice_ and h.at = r.at")).select("h.g", "h.name", F.col("r.x").alias("x"), f"h.{IN_GROUP}")
    return found.groupBy(F.col("g").alias(group)).agg(F.max(IN_GROUP).alias("n"), *[F.max(F.when(F.col("name") == k, F.col("x"))).alias(k) for k in shares])


def first_of_groups(rows: DataFrame, group: str, order: list[Column], quotas: DataFrame, scratch: Scratch) -> DataFrame:
    """rows among the first `quota` of their group in the given total order; quotas: (group, quota), null groups included."""
    placed, counts = sliced(rows, [group], order, scratch)
    q = quotas.select(F.col(group).alias("g_"), "quota")
    open_ = counts.join(F.broadcast(q), F.col(group).eqNullSafe(F.col("g_"))).where(F.col(BEFORE) < F.col("quota")).select("g_", F.col(SLICE).alias("s_"), BEFORE, "quota")
    near = placed.join(open_, F.col(group).eqNullSafe(F.col("g_")) & (F.col(SLICE) == F.col("s_")))
    ranked = near.withColumn("r_", F.col(BEFORE) + F.row_number().over(Window.partitionBy("g_", "s_").orderBy(*order)))
    return ranked.where("r_ <= quota").select(*rows.columns)
