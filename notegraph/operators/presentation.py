"""Presentation of claims: display names, fixed decimals, signed contributions, circular graph layout."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def title(name: Column) -> Column:
    """snake_case as words with capitals; null is empty."""
    return F.initcap(F.regexp_replace(F.coalesce(name, F.lit("")), "_", " "))


def decimals(value: Column, places: int, default: float = 0.0) -> Column:
    return F.format_string(f"%.{places}f", F.coalesce(value, F.lit(default)).cast("double"))


def signed(value: Column, places: int = 2) -> Column:
    """+1.25 or −1.25."""
    v = F.coalesce(value, F.lit(0.0)).cast("double")
    return F.concat(F.when(v >= 0, "+").otherwise("−"), F.format_string(f"%.{places}f", F.abs(v)))


def claim_cards(records: DataFrame) -> DataFrame:
    """records' claim_id, short_id, label and role for display, index and uncertainty with one place (a missing or zero uncertainty shows as 100.0), signals with three."""
    u = F.col("uncertainty_score")
    return records.select(
        "claim_id", F.substring("claim_id", 1, 8).alias("short_id"), title(F.coalesce("calibration_label", F.lit("very_low"))).alias("label_display"), title(F.col("semantic_role")).alias("role_display"),
        decimals(F.col("reliability_index"), 1).alias("index_formatted"), decimals(F.when(u == 0, None).otherwise(u), 1, 100.0).alias("uncertainty_formatted"),
        *[decimals(F.col(s), 3).alias(f"{s}_formatted") for s in ("evidence_strength", "conflict_pressure")],
    )


def component_rows(scored: DataFrame) -> DataFrame:
    """claim_id, signal, display_name, contribution, formatted of every component, in their order (position)."""
    rows = scored.select("claim_id", F.posexplode("components").alias("position", "c"))
    return rows.select("claim_id", "position", F.col("c.signal").alias("signal"), title(F.col("c.signal")).alias("display_name"), F.round("c.contribution", 6).alias("contribution"), signed(F.col("c.contribution")).alias("formatted"))


def circle(nodes: DataFrame, center: str, radius: float = 2.0) -> DataFrame:
    """claim_id, x, y: the centre at the origin, the others, by id, evenly on a circle; meant for one traversal's nodes."""
    others = nodes.where(F.col("claim_id") != center).select("claim_id").distinct()
    w = Window.partitionBy(F.lit(0))
    placed = others.select("claim_id", (F.row_number().over(w.orderBy("claim_id")) - 1).alias("i"), F.count("*").over(w).alias("n"))
    angle = F.lit(2 * math.pi) * F.col("i") / F.col("n")
    ring = placed.select("claim_id", F.round(radius * F.cos(angle), 6).alias("x"), F.round(radius * F.sin(angle), 6).alias("y"))
    return ring.unionByName(nodes.where(F.col("claim_id") == center).select("claim_id").distinct().select("claim_id", F.lit(0.0).alias("x"), F.lit(0.0).alias("y")))
