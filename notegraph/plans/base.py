"""Tables, relations and graphs that the named queries share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from notegraph.lineage import Scratch, exists
from notegraph.operators import graph as G
from notegraph.operators import pipeline
from notegraph.operators import relations as R
from notegraph.operators.records import distinct_claims
from notegraph.session import table

#: Shared topical overlap below which a contradiction is not believed.
RELATEDNESS = 0.03
_BUILT: dict[tuple, object] = {}


def claims_of(spark: SparkSession, d: str) -> DataFrame:
    return distinct_claims(table(spark, d, "claims"))


def flat(spark: SparkSession, d: str) -> DataFrame:
    return R.flat_evidence(table(spark, d, "relationship_evidence"))


def nodes_of(spark: SparkSession, d: str) -> DataFrame:
    return pipeline.nodes_of(table(spark, d, "claims"), table(spark, d, "anchor_claims"))


def typed(spark: SparkSession, d: str, relatedness: float = RELATEDNESS) -> DataFrame:
    """Valid relations of the evidence table, gated by the texts of claims and anchors."""
    return pipeline.typed_relations(nodes_of(spark, d), table(spark, d, "relationship_evidence"), relatedness)


def _once(spark: SparkSession, key: tuple, make):
    """What `make` gives, a tuple or dataclass of written tables, made once per session as long as its files are there."""
    key = (spark.sparkContext.applicationId, *key)
    held = _BUILT.get(key)
    if held is None or not exists(spark, held[1]):
        made, path = make()
        _BUILT[key] = held = (made, path)
    return held[0]


def graph(spark: SparkSession, d: str, relatedness: float = RELATEDNESS) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the signed graph, written once."""

    def make():
        s = Scratch(spark, "query")
        nodes = s.table(nodes_of(spark, d))
        edges = s.table(G.construct(R.resolve_conflicts(pipeline.typed_relations(nodes, table(spark, d, "relationship_evidence"), relatedness))))
        return (nodes, edges), edges._scratch_path

    return _once(spark, ("graph", d, relatedness), make)


def parts(spark: SparkSession, d: str, relatedness: float = RELATEDNESS) -> DataFrame:
    """The signed partitions of the graph, written once."""

    def make():
        found = Scratch(spark, "query").table(G.partitions(*graph(spark, d, relatedness)))
        return found, found._scratch_path

    return _once(spark, ("parts", d, relatedness), make)


def times(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_key").alias("document_id"), "modified_at")
    return pipeline.claim_times(table(spark, d, "claims"), docs)


def scored_graph(spark: SparkSession, d: str, relatedness: float = RELATEDNESS) -> pipeline.ScoredGraph:
    """The graph of all claims and anchors with their eight signals; its tables are written once per session and read by every query."""

    def make():
        docs = table(spark, d, "documents").select(F.col("doc_key").alias("document_id"), F.lower("source").alias("publisher"), F.col("notebook_id").alias("source_id"))
        g = pipeline.build(
            table(spark, d, "claims"), table(spark, d, "relationship_evidence"), table(spark, d, "anchor_claims"), times=times(spark, d),
            sources=docs.dropDuplicates(["document_id"]), relatedness=relatedness,
        )
        return g, g.records._scratch_path

    return _once(spark, ("scored", d, relatedness), make)


def rounded6(df: DataFrame) -> DataFrame:
    """All doubles at six places, so that sums of another order compare equal."""
    return df.withColumns({f.name: F.round(f.name, 6) for f in df.schema.fields if isinstance(f.dataType, DoubleType)})


def claim_records(spark: SparkSession, d: str, relatedness: float = RELATEDNESS) -> DataFrame:
    return rounded6(scored_graph(spark, d, relatedness).records)
