"""Requests, their validation and normalisation, plans with a result cache, and the service that answers them.

Catalyst does the physical planning; a plan here names the request, its strategy and its cache key.
"""

from __future__ import annotations

import hashlib
import json
from collections import OrderedDict
from dataclasses import asdict, dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notegraph.operators import graph as G
from notegraph.operators import scoring, statistics
from notegraph.operators.pipeline import ScoredGraph
from notegraph.operators.predicates import FIELDS, LEVELS, OPERATORS, Page, Predicate, Sort, project, rounded, scan, where_all


class RequestError(ValueError):
    """A request that cannot be planned."""


class ClaimNotFound(KeyError):
    """No claim has the id asked for."""


@dataclass(frozen=True)
class Search:
    predicates: tuple[Predicate, ...] = ()
    text: str | None = None
    sort: Sort | None = None
    page: Page = field(default_factory=Page)
    level: str = "standard"


@dataclass(frozen=True)
class Lookup:
    claim_id: str
    level: str = "standard"


@dataclass(frozen=True)
class Traversal:
    claim_id: str
    depth: int = 2
    relation_type: str | None = None


@dataclass(frozen=True)
class Aggregation:
    histogram: bool = True


@dataclass(frozen=True)
class Explanation:
    claim_id: str
    level: int = 1


@dataclass(frozen=True)
class Export:
    predicates: tuple[Predicate, ...] = ()
    form: str = "json"
    reliability: bool = True


Request = Search | Lookup | Traversal | Aggregation | Explanation | Export
#: Strategy of each request type and whether its result may be cached.
STRATEGIES = {Search: ("filter_scan", True), Lookup: ("point_lookup", True), Traversal: ("graph_traversal", True), Aggregation: ("aggregation", True), Explanation: ("explanation", True), Export: ("export_scan", False)}
EXPORT_FORMS = ("json", "csv", "graphml")


def validate(request: Request) -> Request:
    """The request, if it can be planned: non-empty ids, known fields, operators, levels and forms, limit >= 1, depth 1 to 5."""
    if hasattr(request, "claim_id") and not str(request.claim_id or "").strip():
        raise RequestError("claim_id is empty")
    for p in getattr(request, "predicates", ()):
        if p.field not in FIELDS:
            raise RequestError(f"unknown field {p.field}")
        if p.op not in OPERATORS:
            raise RequestError(f"unknown operator {p.op}")
    if isinstance(request, Search):
        if request.page.limit < 1:
            raise RequestError("limit must be at least 1")
        if request.sort is not None and request.sort.field not in FIELDS:
            raise RequestError(f"unknown sort field {request.sort.field}")
    if isinstance(request, (Search, Lookup)) and request.level not in LEVELS:
        raise RequestError(f"unknown level {request.level}")
    if isinstance(request, Traversal) and not 1 <= request.depth <= 5:
        raise RequestError("depth must be 1 to 5")
    if isinstance(request, Explanation) and request.level not in scoring.EXPLAIN_LEVELS:
        raise RequestError("level must be 0 to 3")
    if isinstance(request, Export) and request.form not in EXPORT_FORMS:
        raise RequestError(f"unknown form {request.form}")
    return request


def normalize(request: Request) -> Request:
    """Predicates sorted, page clamped, text stripped, so that equal requests have equal plans."""
    if hasattr(request, "predicates"):
        request = replace(request, predicates=tuple(sorted(request.predicates, key=lambda p: f"{p.field}:{p.op}:{p.value}")))
    if isinstance(request, Search):
        request = replace(request, page=request.page.clamped(), text=request.text.strip() if request.text is not None else None)
    return request


#: Estimated milliseconds of the strategies and the share of rows an index leaves.
COST_MS = {"point_lookup": 0.1, "indexed_filter": 2.0, "filter_scan": 10.0, "export_scan": 10.0, "graph_traversal": 10.0}
OTHER_MS, INDEX_SELECTIVITY = 20.0, 0.2
FAMILIES = {"Search": "filter", "Lookup": "point", "Traversal": "traversal", "Aggregation": "aggregation", "Explanation": "explainability", "Export": "aggregation"}


@dataclass(frozen=True)
class Cost:
    """An estimate for display; Catalyst decides by its own."""

    rows: int
    ms: float
    selectivity: float = 1.0
    depth: int | None = None


@dataclass(frozen=True)
class Plan:
    plan_id: str
    strategy: str
    cacheable: bool
    request: Request
    family: str
    cost: Cost
    index: str | None = None


def plan(request: Request, run_id: str = "run", entries: dict[str, float] | None = None) -> Plan:
    """The plan of a request.  entries: mean rows per value of the indexed fields, for the choice of an index."""
    r = normalize(validate(request))
    strategy, cacheable = STRATEGIES[type(r)]
    text = json.dumps([type(r).__name__, asdict(r)], sort_keys=True, default=str)
    index = choose_index(r.predicates, entries or {}) if isinstance(r, Search) else None
    name = type(r).__name__
    rows = r.page.limit if isinstance(r, Search) else min(50, 2**r.depth) if isinstance(r, Traversal) else -1 if name == "Export" else 1
    kind = "indexed_filter" if index else "point_lookup" if name == "Explanation" else strategy
    cost = Cost(rows, COST_MS.get(kind, OTHER_MS), INDEX_SELECTIVITY if index else 1.0, r.depth if isinstance(r, Traversal) else None)
    return Plan(hashlib.sha256(f"{run_id}:{text}".encode()).hexdigest()[:16], strategy, cacheable, r, FAMILIES[name], cost, index)


def choose_index(predicates: tuple[Predicate, ...], entries: dict[str, float]) -> str | None:
    """The indexed field among the predicates with the fewest rows per value, the first on ties."""
    known = [p.field for p in predicates if p.field in entries]
    return min(known, key=lambda f: entries[f]) if known else None


#: Fields of the index; the last is the decile of the reliability index.
INDEXED = ("calibration_label", "semantic_role", "document_id", "partition_id", "reliability_index_bucket")


def index_entries(records: DataFrame, fields: tuple[str, ...] = INDEXED) -> DataFrame:
    """field, value, claim_id of the index over records: null values have no entry, the bucket of 100 is 100."""
    rows = records.withColumn("reliability_index_bucket", (F.floor(F.coalesce("reliability_index", F.lit(0.0)) / 10) * 10).cast("int"))
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])
    return rows.select("claim_id", F.explode(pairs).alias("x")).where("x.value is not null").select("x.field", "x.value", "claim_id")


def entries_per_value(index: DataFrame) -> DataFrame:
    """field, n_values, n_entries, mean entries per value: what `plan` chooses by."""
    s = index.groupBy("field", "value").agg(F.count("*").alias("n")).groupBy("field").agg(F.count("*").alias("n_values"), F.sum("n").alias("n_entries"))
    return s.withColumn("per_value", F.round(F.col("n_entries") / F.col("n_values"), 6))


def filter_predicates(filters: dict[str, Any] | None) -> tuple[Predicate, ...]:
    """Predicates of a form's fields: equality, a number for the reliability index as a lower bound; null and empty values ask nothing."""
    out = []
    for name, value in (filters or {}).items():
        if value is not None and value != "":
            number = isinstance(value, (int, float)) and not isinstance(value, bool)
            out.append(Predicate(name, "gte" if number and name == "reliability_index" else "eq", value))
    return tuple(out)


@dataclass(frozen=True)
class Budget:
    """What one request may take: depth and rows are enforced on the plan, the time by cancelling the job group."""

    depth: int = 5
    rows: int = 10_000
    seconds: float = 30.0

    def rows_of(self, df: DataFrame) -> DataFrame:
        return df.limit(self.rows)

    def run(self, df: DataFrame) -> list:
        """Collects at most `rows` rows; a job that takes longer is cancelled and raises RequestError."""
        import threading

        context, group = df.sparkSession.sparkContext, f"budget-{id(df)}"
        late = threading.Event()

        def stop() -> None:
            late.set()
            context.cancelJobGroup(group)

        timer = threading.Timer(self.seconds, stop)
        context.setJobGroup(group, "budgeted request", interruptOnCancel=True)
        timer.start()
        try:
            return self.rows_of(df).collect()
        except Exception as x:
            if late.is_set():
                raise RequestError(f"took longer than {self.seconds} s") from x
            raise
        finally:
            timer.cancel()
            context.setLocalProperty("spark.jobGroup.id", None)


class ResultCache:
    """Least-recently-used DataFrames by plan id; those that Catalyst takes for small are persisted while they are held."""

    def __init__(self, size: int = 256, most_bytes: int = 64 << 20):
        self.size, self.most_bytes, self.hits, self.misses = size, most_bytes, 0, 0
        self.held: OrderedDict[str, Any] = OrderedDict()

    def get(self, key: str) -> Any:
        if key in self.held:
            self.held.move_to_end(key)
            self.hits += 1
            return self.held[key]
        self.misses += 1
        return None

    def put(self, key: str, value: Any) -> Any:
        frames = [v for v in (value.values() if isinstance(value, dict) else [value]) if isinstance(v, DataFrame)]
        for df in frames:
            if int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= self.most_bytes:
                df.persist()
        self.held[key] = value
        while len(self.held) > self.size:
            _, old = self.held.popitem(last=False)
            for df in old.values() if isinstance(old, dict) else [old]:
                if isinstance(df, DataFrame):
                    df.unpersist()
        return value

    @property
    def hit_rate(self) -> float:
        return self.hits / max(1, self.hits + self.misses)


class KnowledgeService:
    """Answers requests over a scored graph with DataFrames, each reading only the columns it needs."""

    def __init__(self, graph: ScoredGraph, run_id: str = "run", cache_size: int = 256):
        self.graph, self.run_id, self.cache = graph, run_id, ResultCache(cache_size)

    def execute(self, request: Request) -> Any:
        p = plan(request, self.run_id)
        if p.cacheable and (held := self.cache.get(p.plan_id)) is not None:
            return held
        answer = getattr(self, "_" + p.strategy)(p.request)
        return self.cache.put(p.plan_id, answer) if p.cacheable else answer

    def _filter_scan(self, r: Search) -> dict[str, DataFrame]:
        rows, total = scan(self.graph.records, list(r.predicates), r.sort, r.page, r.text)
        return {"rows": rounded(project(rows, r.level)), "total": total}

    def _point_lookup(self, r: Lookup) -> DataFrame:
        found = where_all(self.graph.records, [Predicate("claim_id", "eq", r.claim_id)])
        if found.isEmpty():
            raise ClaimNotFound(r.claim_id)
        return rounded(project(found, r.level))

    def _graph_traversal(self, r: Traversal) -> dict[str, DataFrame]:
        nodes, edges = G.traverse(self.graph.nodes, self.graph.edges, r.claim_id, r.depth, r.relation_type)
        return {"nodes": nodes, "edges": edges, "depth": nodes.agg(F.lit(min(r.depth, 5)).alias("depth_requested"), F.max("depth").alias("depth_reached"))}

    def _aggregation(self, r: Aggregation) -> dict[str, DataFrame]:
        records = self.graph.records
        out = {"overview": statistics.overview(records), "labels": records.groupBy("calibration_label").agg(F.count("*").alias("n"))}
        if r.histogram:
            out["histogram"] = statistics.histogram(records, F.col("reliability_index"))
        out["partitions"] = records.groupBy("partition_id").agg(F.count("*").alias("n_nodes"), F.round(F.avg("reliability_index"), 2).alias("mean_reliability")).orderBy(F.desc("mean_reliability"), "partition_id")
        return out

    def _explanation(self, r: Explanation) -> DataFrame:
        found = self.graph.scored.where(F.col("claim_id") == r.claim_id)
        if found.isEmpty():
            raise ClaimNotFound(r.claim_id)
        return scoring.explain_level(found, r.level)

    def _export_scan(self, r: Export) -> DataFrame:
        from notegraph.sources.sinks import graphml_lines

        rows = where_all(self.graph.records, list(r.predicates))
        if r.form == "graphml":
            return graphml_lines(rows, self.graph.edges.withColumnsRenamed({"source": "claim_id_a", "target": "claim_id_b"}))
        names = ["claim_id", "claim_text", "context", "document_id", "partition_id", "semantic_role"] + ["reliability_index", "uncertainty_score", "calibration_label"] * r.reliability
        rows = rows.select(*names)
        return rows.select(F.to_json(F.struct(*names)).alias("line")) if r.form == "json" else rows


def capabilities() -> dict[str, Any]:
    return {"requests": {k.__name__: {"strategy": s, "cacheable": c} for k, (s, c) in STRATEGIES.items()}, "fields": FIELDS, "operators": OPERATORS, "levels": tuple(LEVELS), "export_forms": EXPORT_FORMS, "indexed": INDEXED, "families": FAMILIES}


@dataclass(frozen=True)
class Guards:
    """Limits of interactive use."""

    max_nodes: int = 50
    max_compare: int = 2
    max_offset: int = 10_000
    max_depth: int = 3

    def check(self, nodes: int = 0, compare: int = 0, offset: int = 0, depth: int = 0, form: str = "json") -> None:
        for name, value, most in (("nodes", nodes, self.max_nodes), ("compare", compare, self.max_compare), ("offset", offset, self.max_offset), ("depth", depth, self.max_depth)):
            if value > most:
                raise RequestError(f"{name} {value} exceeds {most}")
        if form not in EXPORT_FORMS:
            raise RequestError(f"unknown form {form}")
