"""Sinks: JSON, CSV, GraphML, phase datasets with manifests and resume state."""

from __future__ import annotations

import hashlib
import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from notegraph import lineage


def escape(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def graphml_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """line: node elements with labels cut to 80 characters after escaping, then edge elements of all edges."""
    n = nodes.select(F.format_string('<node id="%s"><data key="label">%s</data></node>', "claim_id", F.substring(escape(F.col("claim_text")), 1, 80)).alias("line"))
    e = edges.select(F.format_string('<edge id="%s" source="%s" target="%s"/>', "edge_id", "claim_id_a", "claim_id_b").alias("line"))
    return n.unionByName(e)


def write_graphml(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """GraphML body lines as text part files; header and footer belong to whoever joins them."""
    graphml_lines(nodes, edges).write.mode("overwrite").text(path)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def export_json(rows: DataFrame, run_id: str) -> DataFrame:
    """value: one JSON object {run_id, claim} per row, so that no task holds the whole export."""
    return rows.select(F.to_json(F.struct(F.lit(run_id).alias("run_id"), F.struct(*rows.columns).alias("claim")), {"ignoreNullFields": "false"}).alias("value"))


def csv_lines(rows: DataFrame, *columns: str) -> DataFrame:
    """line: the columns as CSV, quoted where they need it, nulls empty."""
    return rows.select(F.to_csv(F.struct(*columns), {"escape": '"'}).alias("line"))


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", "true").csv(path)


class PhaseStore:
    """Phase outputs as Parquet under `<root>/run_<id>/phase<n>` with a manifest each, and the state to resume from.

    The manifest is written after the data, so a phase without one is run again.  Both go
    through the file system that the root names, so any shared store will do.
    """

    def __init__(self, root: str | Path, run_id: str):
        self.root = f"{str(root).rstrip('/')}/run_{run_id}"
        self.run_id = run_id

    def write(self, phase: int, df: DataFrame, **facts) -> None:
        path = f"{self.root}/phase{phase}"
        df.write.mode("overwrite").parquet(f"{path}/dataset")
        fields = json.dumps(df.schema.jsonValue(), sort_keys=True)
        manifest = {"run_id": self.run_id, "phase": phase, "schema": df.schema.jsonValue(), "schema_hash": hashlib.sha256(fields.encode()).hexdigest()[:16], **facts}
        lineage.write_text(df.sparkSession, f"{path}/manifest.json", json.dumps(manifest))

    def completed(self, spark: SparkSession) -> list[int]:
        return sorted(int(p.rsplit("/", 2)[-2][5:]) for p in lineage.glob(spark, f"{self.root}/phase*/manifest.json"))

    def resume_from(self, spark: SparkSession) -> int:
        done = self.completed(spark)
        return max(done) + 1 if done else 1

    def replay(self, spark: SparkSession, phase: int, again) -> bool:
        """Whether again(), run anew, gives the rows that the phase wrote (compared by counts of equal rows)."""
        held, made = self.read(spark, phase), again()
        counted = held.withColumn("n_", F.lit(1)).unionByName(made.select(held.columns).withColumn("n_", F.lit(-1)))
        keys = [F.to_json(F.struct(*held.columns), {"ignoreNullFields": "false"}).alias("row")]
        return counted.select(*keys, "n_").groupBy("row").agg(F.sum("n_").alias("d")).where("d != 0").isEmpty()

    def read(self, spark: SparkSession, phase: int) -> DataFrame:
        from pyspark.sql.types import StructType

        path = f"{self.root}/phase{phase}"
        manifest = json.loads(lineage.read_text(spark, f"{path}/manifest.json"))
        return spark.read.schema(StructType.fromJson(manifest["schema"])).parquet(f"{path}/dataset")
