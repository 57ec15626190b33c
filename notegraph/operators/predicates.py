"""Predicates, sorting, paging, projections and views of the query engine, as Column expressions."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType, StringType

OPERATORS = ("eq", "neq", "gt", "gte", "lt", "lte", "in")
#: Fields that predicates and sorting may name.
FIELDS = (
    "claim_id", "claim_text", "context", "document_id", "source_path", "partition_id", "semantic_role", "reliability_index", "uncertainty_score", "evidence_completeness",
    "calibration_label", "degree", "in_degree", "centrality", "is_hub", "is_bridge", "support_count", "weighted_confidence", "temporal_status", "evidence_strength", "conflict_pressure",
    "extraction_mode", "is_negated", "modality",
)
#: Columns of the projection levels.
LEVELS: dict[str, tuple[str, ...]] = {
    "summary": ("claim_id", "claim_text", "context", "reliability_index", "calibration_label", "uncertainty_score"),
    "standard": (
        "claim_id", "claim_text", "reliability_index", "calibration_label", "uncertainty_score", "document_id", "source_path", "partition_id", "semantic_role", "degree", "centrality", "support_count",
    ),
}
LEVELS["detailed"] = (*LEVELS["standard"], "temporal_status", "evidence_strength", "conflict_pressure", "evidence_completeness")
LEVELS["explainability"] = (*LEVELS["detailed"], "explanation_summary", "dominant_signal", "limiting_signal", "component_scores", "recommendations")
LEVELS["full_audit"] = (*LEVELS["explainability"], "policy_version", "audit_run_id")


@dataclass(frozen=True)
class Predicate:
    """field op value; op is one of OPERATORS and value a list for `in`."""

    field: str
    op: str
    value: Any

    def column(self, df: DataFrame) -> Column:
        """True or false, never null: EQ null = null is true, NEQ on null is true, ranges over null or another type are false."""
        if self.op not in OPERATORS:
            raise ValueError(f"unknown operator {self.op}")
        col = df[self.field]
        kind = df.schema[self.field].dataType
        if self.op == "in":
            values = [v for v in self.value if v is not None and _fits(kind, v)]
            hit = F.coalesce(col.isin(values), F.lit(False)) if values else F.lit(False)
            return hit | col.isNull() if any(v is None for v in self.value) else hit
        fits = self.value is None or _fits(kind, self.value)
        if self.op == "eq":
            return col.eqNullSafe(F.lit(self.value)) if fits else F.lit(False)
        if self.op == "neq":
            return ~col.eqNullSafe(F.lit(self.value)) if fits else F.lit(True)
        if self.value is None or not fits:
            return F.lit(False)
        value = F.lit(self.value)
        test = {"gt": col > value, "gte": col >= value, "lt": col < value, "lte": col <= value}[self.op]
        return F.coalesce(test, F.lit(False))


def _fits(kind, value: Any) -> bool:
    if isinstance(value, bool):
        return isinstance(kind, (BooleanType, NumericType))
    if isinstance(value, (int, float)):
        return isinstance(kind, (NumericType, BooleanType))
    return isinstance(value, str) and isinstance(kind, StringType)


@dataclass(frozen=True)
class Sort:
    field: str
    descending: bool = False


@dataclass(frozen=True)
class Page:
    limit: int = 50
    offset: int = 0

    def clamped(self, most: int = 1000) -> Page:
        return Page(max(1, min(self.limit, most)), max(0, self.offset))


def where_all(df: DataFrame, predicates: list[Predicate], text_contains: str | None = None, text_field: str = "claim_text") -> DataFrame:
    """Rows that satisfy every predicate and hold the text, in any letter case.

    Predicates that push down (everything but null-safe negation) reach the scan as Catalyst filters.
    """
    tests = [p.column(df) for p in predicates]
    if text_contains:
        tests.append(F.coalesce(F.lower(df[text_field]).contains(text_contains.lower()), F.lit(False)))
    return df.where(reduce(lambda a, b: a & b, tests)) if tests else df


def ordered(df: DataFrame, sort: Sort | None, tie: str = "claim_id") -> list[Column]:
    """Sort columns with the tie broken by ascending id also for descending order; null counts as 0, "" or false."""
    if sort is None:
        return [F.asc(tie)]
    kind = df.schema[sort.field].dataType
    zero = F.lit("") if isinstance(kind, StringType) else F.lit(False) if isinstance(kind, BooleanType) else F.lit(0)
    key = F.coalesce(df[sort.field], zero)
    return [key.desc() if sort.descending else key.asc(), F.asc(tie)]


def scan(df: DataFrame, predicates: list[Predicate], sort: Sort | None = None, page: Page | None = None, text_contains: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(page of the rows, one-row DataFrame `total`): filter, sort, slice; the page is a TakeOrderedAndProject."""
    page = (page or Page()).clamped()
    kept = where_all(df, predicates, text_contains)
    return kept.orderBy(*ordered(kept, sort)).offset(page.offset).limit(page.limit), kept.agg(F.count("*").alias("total"))


def project(df: DataFrame, level: str) -> DataFrame:
    """The columns of a projection level; Catalyst prunes the rest from the scan.  A table that lacks one is an error."""
    missing = [c for c in LEVELS[level] if c not in df.columns]
    if missing:
        raise ValueError(f"no {', '.join(missing)} for the projection {level}")
    return df.select(*LEVELS[level])


def claim_view(records: DataFrame, reliability: DataFrame) -> DataFrame:
    """Records with their reliability, missing ones at 0, uncertainty 100 and label very_low."""
    own = [c for c in reliability.columns if c == "claim_id" or c not in records.columns]
    joined = records.join(reliability.select(*own), "claim_id", "left")
    defaults = {"reliability_index": 0.0, "uncertainty_score": 100.0, "evidence_completeness": 0.0, "calibration_label": "very_low"}
    return joined.fillna({k: v for k, v in defaults.items() if k in joined.columns})


def rounded(df: DataFrame) -> DataFrame:
    """Presentation rounding: indices 2, centrality 4, signals 3 places."""
    places = {"reliability_index": 2, "uncertainty_score": 2, "centrality": 4, "evidence_strength": 3, "conflict_pressure": 3, "weighted_confidence": 3}
    return df.withColumns({c: F.round(c, n) for c, n in places.items() if c in df.columns})
