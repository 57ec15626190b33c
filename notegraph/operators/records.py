"""One row per claim of a table of claim rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def distinct_claims(claims: DataFrame) -> DataFrame:
    """One row per claim_id of a table with exact repeats; null ids are left out."""
    return claims.where("claim_id is not null").groupBy("claim_id").agg(
        F.min("text").alias("claim_text"), F.min("context").alias("context"), F.min("document_id").alias("document_id"), F.min("source_path").alias("source_path"),
        F.min("extraction_mode").alias("extraction_mode"), F.bool_or("is_negated").alias("is_negated"), F.min("modality").alias("modality"),
    )
