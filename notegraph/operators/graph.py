"""The signed claim graph: construction, partitions, topology, support, temporal order, roles and traversal.

Components, colours, support and traversal are iterative joins whose rounds are written to the
shared folder; bridges and the longest chain of a partition, and the relaxation of odd contradiction
components, run grouped by partition or component.
"""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notegraph.lineage import Scratch

TYPES = ("supports", "refines", "equivalent", "contradicts")
STRUCTURAL = ("supports", "refines", "equivalent")
HOP_WEIGHTS = (1.0, 0.6, 0.3)


class GraphError(ValueError):
    """A graph that breaks an invariant."""


def construct(relations: DataFrame, include_neutral: bool = False) -> DataFrame:
    """edge_id, source, target, relation_type, direction, confidence, cosine_similarity, candidate_rank.

    source is claim_id_a and target claim_id_b whatever the direction, and the confidence is the
    a-to-b one; repeated edge ids count once, other types and self loops of null ends are left out.
    """
    kinds = [*TYPES, "neutral"] if include_neutral else list(TYPES)
    rows = relations.where(F.col("relation_type").isin(*kinds) & F.col("claim_id_a").isNotNull() & F.col("claim_id_b").isNotNull())
    return rows.groupBy("edge_id").agg(
        *[F.min(a).alias(b) for a, b in (("claim_id_a", "source"), ("claim_id_b", "target"), ("relation_type", "relation_type"), ("direction", "direction"), ("conf_ab", "confidence"), ("cosine_similarity", "cosine_similarity"), ("candidate_rank", "candidate_rank"))]
    )


def endpoints(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("source", "target")).alias("claim_id")).distinct()


def problems(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """problem, n: dangling ends, empty texts, unknown types, confidences out of range, repeated node ids."""
    ids = nodes.select("claim_id").distinct()
    one = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("problem"), "n")
    ends = edges.select(F.explode(F.array("source", "target")).alias("claim_id"))
    return (
        one(ends.join(ids, "claim_id", "left_anti"), "dangling_end").unionByName(one(nodes.where(F.trim(F.coalesce("claim_text", F.lit(""))) == ""), "empty_text"))
        .unionByName(one(edges.where(~F.col("relation_type").isin(*TYPES, "neutral")), "unknown_type"))
        .unionByName(one(edges.where(~F.coalesce((F.col("confidence") >= 0) & (F.col("confidence") <= 1), F.lit(False))), "confidence_out_of_range"))
        .unionByName(one(nodes.groupBy("claim_id").agg(F.count("*").alias("c")).where("c > 1"), "repeated_id"))
    )


def validate(nodes: DataFrame, edges: DataFrame) -> None:
    found = [f"{r['problem']}: {r['n']}" for r in problems(nodes, edges).where("n > 0").collect()]
    if found:
        raise GraphError("; ".join(found))


def components(nodes: DataFrame, edges: DataFrame, scratch: Scratch, label: str = "component") -> DataFrame:
    """claim_id, label: the smallest id reachable over the edges taken undirected; nodes without edges stand alone."""
    found = _labels(edges, scratch).select("claim_id", "l")
    return nodes.select("claim_id").distinct().join(found, "claim_id", "left").select("claim_id", F.coalesce("l", "claim_id").alias(label))


def _labels(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """claim_id, l, par of linked nodes: the smallest id reachable and the parity of a walk to it.

    Per round every node takes the smallest label around it and then its label's own label, so
    rounds grow with the logarithm of the diameter; parities add up along the walks.  Nodes
    without edges have no row.
    """
    both = edges.select(F.col("source").alias("x"), F.col("target").alias("y")).where("x != y")
    both = scratch.table(both.unionByName(both.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct())
    state = scratch.table(both.select(F.col("x").alias("claim_id")).distinct().select("claim_id", F.col("claim_id").alias("l"), F.lit(0).alias("par"), F.lit(True).alias("moved")))
    while not both.isEmpty():
        around = both.join(state.select(F.col("claim_id").alias("y"), "l", "par"), "y").groupBy(F.col("x").alias("claim_id")).agg(F.min(F.struct("l", (1 - F.col("par")).alias("par"))).alias("m"))
        better = F.col("m.l") < F.col("l")
        step = scratch.table(state.join(around, "claim_id", "left").select(
            "claim_id", F.col("l").alias("old"), F.when(better, F.col("m.l")).otherwise(F.col("l")).alias("l"), F.when(better, F.col("m.par")).otherwise(F.col("par")).alias("par")
        ))
        jump = step.select(F.col("claim_id").alias("l"), F.col("l").alias("ll"), F.col("par").alias("pp"))
        further = F.col("ll") < F.col("l")
        after = step.join(jump, "l", "left").select(
            "claim_id", F.when(further, F.col("ll")).otherwise(F.col("l")).alias("l"), F.when(further, (F.col("par") + F.col("pp")) % 2).otherwise(F.col("par")).alias("par"), "old"
        )
        after = scratch.table(after.select("claim_id", "l", "par", (F.col("l") != F.col("old")).alias("moved")))
        scratch.drop(state, step)
        state = after
        if state.where("moved").isEmpty():
            break
    return state


def colours(nodes: DataFrame, edges: DataFrame, scratch: Scratch) -> DataFrame:
    """claim_id, colour: two colours per contradiction component by the parity of the distance from its smallest id.

    Where two colours do, the parity of every walk to the smallest id is that of the distance.
    Nodes without contradictions get 0; in a component with an odd cycle (a self contradiction
    included) every node gets a colour of its own.
    """
    contra = scratch.table(edges.where("relation_type = 'contradicts'").select("source", "target"))
    parity = scratch.table(_labels(contra, scratch).select("claim_id", F.col("l").alias("component"), "par"))
    loops = contra.where("source = target").select(F.col("source").alias("claim_id")).distinct()
    alone = loops.join(parity, "claim_id", "left_anti").select("claim_id", F.col("claim_id").alias("component"), F.lit(0).alias("par"))
    parity = parity.unionByName(alone)
    a = parity.select(F.col("claim_id").alias("source"), F.col("component"), F.col("par").alias("pa"))
    b = parity.select(F.col("claim_id").alias("target"), F.col("par").alias("pb"))
    odd = contra.join(a, "source").join(b, "target").where("pa = pb").select("component").distinct().withColumn("odd", F.lit(True))
    own = parity.join(odd, "component", "left").select("claim_id", F.when(F.col("odd"), F.concat(F.lit("x:"), F.col("claim_id"))).otherwise(F.col("par").cast("string")).alias("colour"))
    return nodes.select("claim_id").distinct().join(own, "claim_id", "left").select("claim_id", F.coalesce("colour", F.lit("0")).alias("colour"))


def _named(comp: DataFrame) -> DataFrame:
    """comp with partition_id, the digest of its sorted ids."""
    ids = comp.groupBy("component").agg(F.substring(F.sha2(F.array_join(F.array_sort(F.collect_list("claim_id")), "|"), 256), 1, 12).alias("partition_id"))
    return comp.join(ids, "component").select("claim_id", "partition_id")


def partitions(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """claim_id, colour, partition_id: components of supporting, refining and equivalent edges between nodes of one colour.

    No contradiction lies inside a partition; if one did, GraphError is raised.
    """
    scratch = Scratch(nodes.sparkSession, "partitions")
    colour = scratch.table(colours(nodes, edges, scratch))
    a = colour.select(F.col("claim_id").alias("source"), F.col("colour").alias("ca"))
    b = colour.select(F.col("claim_id").alias("target"), F.col("colour").alias("cb"))
    kept = edges.where(F.col("relation_type").isin(*STRUCTURAL)).join(a, "source").join(b, "target").where("ca = cb").select("source", "target")
    out = scratch.table(_named(components(nodes, kept, scratch)).join(colour, "claim_id"))
    if not violations(edges, out).isEmpty():
        raise GraphError("a contradiction lies inside a partition")
    return out


def placed(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """edges with the partitions of both ends, p_source and p_target."""
    a = parts.select(F.col("claim_id").alias("source"), F.col("partition_id").alias("p_source"))
    b = parts.select(F.col("claim_id").alias("target"), F.col("partition_id").alias("p_target"))
    return edges.join(a, "source").join(b, "target")


def violations(edges: DataFrame, parts: DataFrame) -> DataFrame:
    return placed(edges, parts).where("relation_type = 'contradicts' and p_source = p_target")


def naive_partitions(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """claim_id, partition_id: components of all edges."""
    return _named(components(nodes, edges, Scratch(nodes.sparkSession, "naive")))


def deletion_partitions(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """claim_id, partition_id: components without the contradictions."""
    return _named(components(nodes, edges.where("relation_type != 'contradicts'"), Scratch(nodes.sparkSession, "deletion")))


def weighted_partitions(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """claim_id, partition_id: per contradiction component the weakest contradictions (ties by edge id) are dropped until two colours do, then as `partitions`."""
    scratch = Scratch(nodes.sparkSession, "weighted")
    contra = edges.where("relation_type = 'contradicts'")
    comp = components(endpoints(contra), contra, scratch)

    def relax(g: pd.DataFrame) -> pd.DataFrame:
        root: dict[str, tuple[str, int]] = {}

        def find(x: str) -> tuple[str, int]:
            sign = 0
            while x in root:
                x, s = root[x]
                sign ^= s
            return x, sign

        kept = []
        # strongest first, joined by parity: an edge that would close an odd cycle is among the weakest of it
        for r in g.sort_values(["confidence", "edge_id"], ascending=[False, True]).itertuples():
            (a, x), (b, y) = find(r.source), find(r.target)
            if a != b:
                root[max(a, b)] = (min(a, b), x ^ y ^ 1)
                kept.append(r.edge_id)
            elif x != y:
                kept.append(r.edge_id)
        return pd.DataFrame({"edge_id": kept})

    at = contra.join(comp.withColumnRenamed("claim_id", "source"), "source").select("component", "edge_id", "source", "target", "confidence")
    kept = scratch.table(at.groupBy("component").applyInPandas(relax, "edge_id string"))
    return partitions(nodes, edges.where("relation_type != 'contradicts'").unionByName(contra.join(kept, "edge_id", "left_semi").select(edges.columns))).select("claim_id", "partition_id")


def quality(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """One row: partitions, violations, retained and cut edges, singleton rate, average and greatest size."""
    sizes = parts.groupBy("partition_id").agg(F.count("*").alias("n"))
    s = sizes.agg(F.count("*").alias("n_partitions"), F.round(F.avg((F.col("n") == 1).cast("double")), 6).alias("singleton_rate"), F.round(F.avg("n"), 6).alias("avg_size"), F.max("n").alias("max_size"))
    inside = F.col("p_source") == F.col("p_target")
    contra = F.col("relation_type") == "contradicts"
    e = placed(edges, parts).agg(F.count_if(inside & contra).alias("violations"), F.count_if(inside & ~contra).alias("retained"), F.count_if(~inside & ~contra).alias("cut"))
    return s.crossJoin(e)  # one row each


def quality_by_type(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """relation_type, n_inside, n_cut: edges whose ends share a partition, and others."""
    inside = F.col("p_source") == F.col("p_target")
    return placed(edges, parts).groupBy("relation_type").agg(F.count_if(inside).alias("n_inside"), F.count_if(~inside).alias("n_cut"))


def _longest_path(edges: set[tuple[str, str]]) -> int:
    """Nodes of the longest simple path: by one pass in topological order, where there are cycles by search from every node."""
    out, waiting = defaultdict(list), defaultdict(int)
    for a, b in sorted(edges):
        out[a].append(b)
        waiting[b] += 1
    best: dict[str, int] = defaultdict(lambda: 1)
    ready = [x for x in list(out) if not waiting[x]]
    done = 0
    while ready:
        x = ready.pop()
        done += 1
        for y in out[x]:
            best[y] = max(best[y], best[x] + 1)
            waiting[y] -= 1
            if not waiting[y]:
                ready.append(y)
    if done == len({x for e in edges for x in e}):
        return max(best.values(), default=0)
    longest = 0
    for start in sorted(out):
        stack: list[tuple[str, frozenset]] = [(start, frozenset((start,)))]
        while stack:
            at, seen = stack.pop()
            longest = max(longest, len(seen))
            stack += [(b, seen | {b}) for b in out.get(at, ()) if b not in seen]
    return longest


def partition_table(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """partition_id, n_nodes, n_edges, n_supports, density, longest_chain.

    density is the inner edges without contradictions over n (n - 1); the chain is the longest
    simple path of supports in nodes, 0 without supports: linear work for a partition whose
    supports form no cycle, else exponential in its cycles, as the question itself is.
    """
    inner = placed(edges, parts).where("p_source = p_target")
    sizes = parts.groupBy("partition_id").agg(F.count("*").alias("n_nodes"))
    counts = inner.groupBy(F.col("p_source").alias("partition_id")).agg(F.count_if(F.col("relation_type") != "contradicts").alias("n_edges"), F.count_if(F.col("relation_type") == "supports").alias("n_supports"))

    def chain(g: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"partition_id": [g["p_source"].iloc[0]], "longest_chain": [_longest_path(set(zip(g["source"], g["target"], strict=True)))]})

    chains = inner.where("relation_type = 'supports' and source != target").select("p_source", "source", "target").groupBy("p_source").applyInPandas(chain, "partition_id string, longest_chain int")
    n = F.col("n_nodes")
    return (
        sizes.join(counts, "partition_id", "left").join(chains, "partition_id", "left").fillna(0)
        .withColumn("density", F.round(F.col("n_edges") / F.when(n == 1, F.lit(1)).otherwise(n * (n - 1)), 6))
    )


def topology(edges: DataFrame, parts: DataFrame, hub_multiplier: float = 2.0) -> DataFrame:
    """claim_id, partition_id, degree, in_degree, out_degree, centrality, is_hub, is_bridge, inside the partition.

    Equivalences count in both directions; centrality is in-degree over n - 1; hubs have more than
    max(1, multiplier * mean) edges; bridges are articulation points.
    """
    inner = placed(edges, parts).where("p_source = p_target and relation_type != 'contradicts'").select("p_source", "source", "target", "relation_type")
    twice = inner.unionByName(inner.where("relation_type = 'equivalent'").select("p_source", F.col("target").alias("source"), F.col("source").alias("target"), "relation_type"))
    into = twice.groupBy(F.col("target").alias("claim_id")).agg(F.count("*").alias("in_degree"))
    out = twice.groupBy(F.col("source").alias("claim_id")).agg(F.count("*").alias("out_degree"))
    rows = parts.select("claim_id", "partition_id").join(into, "claim_id", "left").join(out, "claim_id", "left").fillna(0, ["in_degree", "out_degree"])
    rows = rows.withColumn("degree", F.col("in_degree") + F.col("out_degree"))
    per = rows.groupBy("partition_id").agg(F.count("*").alias("n"), F.avg("degree").alias("mean"))
    bridges = articulation_points(inner).withColumn("is_bridge", F.lit(True))
    rows = rows.join(per, "partition_id").join(bridges, "claim_id", "left")
    return rows.select(
        "claim_id", "partition_id", "degree", "in_degree", "out_degree", F.when(F.col("n") > 1, F.round(F.col("in_degree") / (F.col("n") - 1), 6)).otherwise(0.0).alias("centrality"),
        (F.col("degree") > F.greatest(F.lit(1.0), hub_multiplier * F.col("mean"))).alias("is_hub"), F.coalesce("is_bridge", F.lit(False)).alias("is_bridge"),
    )


def _articulation(pairs: list[tuple[str, str]]) -> list[str]:
    """Articulation points of an undirected graph, depth-first without recursion."""
    near = defaultdict(set)
    for a, b in pairs:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    order: dict[str, int] = {}
    low: dict[str, int] = {}
    cut: set[str] = set()
    for root in sorted(near):
        if root in order:
            continue
        order[root] = low[root] = len(order)
        children = 0
        stack = [(root, None, iter(sorted(near[root])))]
        while stack:
            at, parent, it = stack[-1]
            for b in it:
                if b not in order:
                    order[b] = low[b] = len(order)
                    stack.append((b, at, iter(sorted(near[b]))))
                    break
                if b != parent:
                    low[at] = min(low[at], order[b])
            else:
                stack.pop()
                if parent is not None:
                    low[parent] = min(low[parent], low[at])
                    if parent == root:
                        children += 1
                    elif low[at] >= order[parent]:
                        cut.add(parent)
        if children > 1:
            cut.add(root)
    return sorted(cut)


def articulation_points(inner: DataFrame) -> DataFrame:
    """claim_id of the articulation points of every partition's undirected graph; inner: (p_source, source, target)."""

    def find(g: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"claim_id": _articulation(list(zip(g["source"], g["target"], strict=True)))}, dtype=object)

    return inner.select("p_source", "source", "target").groupBy("p_source").applyInPandas(find, "claim_id string")


def support(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """claim_id, support_count, supporting_ids, group_ids, direct, derived, multi_hop, weighted_confidence, discounted_strength, discounted_confidence.

    Supporters are all claims that reach a claim over supports and equivalences (both ways) inside
    its partition, at their shortest hop.  Equivalent supporters form one group at its least hop;
    hops 1, 2 and more weigh 1, .6 and .3.  A supporter's confidence is that of its first support
    edge by edge id.  Claims without supporters have counts 0.

    Pairs of claim and supporter grow by one hop a round, as joins; rounds are as many as the
    longest shortest way, rows as many as there are supporters to report.
    """
    scratch = Scratch(parts.sparkSession, "support")
    inner = scratch.table(placed(edges, parts).where("p_source = p_target and relation_type in ('supports', 'equivalent')").select("edge_id", "source", "target", "relation_type", "confidence"))
    same = inner.where("relation_type = 'equivalent' and source != target").select("source", "target")
    back = same.select(F.col("target").alias("source"), F.col("source").alias("target"))
    steps = scratch.table(inner.where("source != target").select("source", "target").unionByName(back).distinct().select(F.col("source").alias("s"), F.col("target").alias("at")))
    reached = scratch.table(steps.select(F.col("at").alias("node"), "s", F.lit(1).alias("hop")))
    hop = 1
    while True:
        front = reached.where(F.col("hop") == hop).select("node", F.col("s").alias("at"))
        new = front.join(steps, "at").where("s != node").select("node", "s").distinct().join(reached, ["node", "s"], "left_anti")
        new = scratch.table(new.withColumn("hop", F.lit(hop + 1)))
        if new.isEmpty():
            break
        both = scratch.table(reached.unionByName(new))
        scratch.drop(reached, new)
        reached, hop = both, hop + 1
    ends = inner.select("edge_id", "confidence", F.col("source").alias("s")).unionByName(inner.where("relation_type = 'equivalent'").select("edge_id", "confidence", F.col("target").alias("s")))
    first = ends.groupBy("s").agg(F.min(F.struct("edge_id", "confidence")).alias("x")).select("s", F.col("x.confidence").alias("conf"))
    grouped = scratch.table(_equivalent_groups(reached, same, scratch).join(first, "s", "left").withColumn("conf", F.coalesce("conf", F.lit(0.0))))
    per_group = grouped.groupBy("node", "root").agg(F.min("hop").alias("h"), F.avg("conf").alias("mean"))
    weight = F.when(F.col("h") == 1, HOP_WEIGHTS[0]).when(F.col("h") == 2, HOP_WEIGHTS[1]).otherwise(HOP_WEIGHTS[2])
    ids = lambda test: F.array_sort(F.collect_list(F.when(test, F.col("root"))))
    groups = per_group.withColumn("w", weight).groupBy("node").agg(
        ids(F.lit(True)).alias("group_ids"), ids(F.col("h") == 1).alias("direct"), ids(F.col("h") == 2).alias("derived"), ids(F.col("h") > 2).alias("multi_hop"),
        F.round(F.sum("w"), 6).alias("discounted_strength"), F.round(F.sum(F.col("w") * F.col("mean")) / F.sum("w"), 6).alias("discounted_confidence"),
    )
    members = grouped.groupBy("node").agg(F.count("*").alias("support_count"), F.array_sort(F.collect_list("s")).alias("supporting_ids"), F.round(F.avg("conf"), 6).alias("weighted_confidence"))
    found = members.join(groups, "node").withColumnRenamed("node", "claim_id")
    out = parts.select("claim_id").join(found, "claim_id", "left").fillna(0, ["support_count", "weighted_confidence", "discounted_strength", "discounted_confidence"])
    empty = F.array().cast("array<string>")
    out = out.withColumns({c: F.coalesce(c, empty) for c in ("supporting_ids", "group_ids", "direct", "derived", "multi_hop")})
    return out.select("claim_id", "support_count", "supporting_ids", "group_ids", "direct", "derived", "multi_hop", "weighted_confidence", "discounted_strength", "discounted_confidence")


def _equivalent_groups(reached: DataFrame, same: DataFrame, scratch: Scratch) -> DataFrame:
    """reached with root: the smallest of the supporters of the same node that are equivalent, without a way over the node itself.

    Supporters outside the node's own class of equivalents form whole classes, so the class's smallest
    id is their root; only inside the node's own class, which may fall apart without it, components
    are computed per node.
    """
    label = scratch.table(_labels(same, scratch).select("claim_id", "l"))
    x = reached.join(label.select(F.col("claim_id").alias("s"), F.col("l").alias("ls")), "s", "left").join(label.select(F.col("claim_id").alias("node"), F.col("l").alias("ln")), "node", "left")
    x = scratch.table(x.withColumn("own", F.coalesce(F.col("ls") == F.col("ln"), F.lit(False))))
    key = lambda c: F.concat_ws("\u0001", F.col("node"), F.col(c))
    near = x.where("own").select("node", "s").join(same.select(F.col("source").alias("s"), F.col("target").alias("t")), "s").where("t != node")
    roots = _labels(near.select(key("s").alias("source"), key("t").alias("target")), scratch).select(F.col("claim_id").alias("k"), F.substring_index("l", "\u0001", -1).alias("r"))
    return x.withColumn("k", F.when(F.col("own"), key("s"))).join(roots, "k", "left").select("node", "s", "hop", F.when(F.col("own"), F.coalesce("r", "s")).otherwise(F.coalesce("ls", "s")).alias("root"))


def temporal(nodes: DataFrame, edges: DataFrame, times: DataFrame, min_delta: float = 1.0) -> DataFrame:
    """claim_id, temporal_status, temporal_confidence, time_delta_days, counterpart.

    Contradictions are taken in edge id order, a pair being passed over only if both its claims
    are settled, a later pair otherwise overwriting.  A claim is settled by its first pair, so a pair
    counts if it is the first of either of its claims, and a claim takes the last pair that counts.
    no_timestamp where a time is missing, unresolved below `min_delta` days, else evolution with
    confidence min(1, days / max(30 min_delta, 30)).  Others are static_partition.  times: (claim_id, ts).
    """
    contra = edges.where("relation_type = 'contradicts' and source != target").select("edge_id", "source", "target")
    t = times.groupBy("claim_id").agg(F.min(F.col("ts").cast("timestamp")).alias("ts")).select("claim_id", (F.unix_micros("ts") / 86_400_000_000.0).alias("day"))
    ends = contra.select("edge_id", F.explode(F.array(F.struct(F.col("source").alias("claim_id"), F.col("target").alias("other")), F.struct(F.col("target").alias("claim_id"), F.col("source").alias("other")))).alias("x")).select("edge_id", "x.*")
    counted = ends.groupBy("claim_id").agg(F.min("edge_id").alias("edge_id")).select("edge_id").distinct()
    last = ends.join(counted, "edge_id", "left_semi").groupBy("claim_id").agg(F.max(F.struct("edge_id", "other")).alias("x")).select("claim_id", F.col("x.other").alias("counterpart"))
    last = last.join(t.withColumnRenamed("day", "a"), "claim_id", "left").join(t.select(F.col("claim_id").alias("counterpart"), F.col("day").alias("b")), "counterpart", "left")
    delta = F.abs(F.col("a") - F.col("b"))
    found = last.select(
        "claim_id", F.when(delta.isNull(), "no_timestamp").when(delta < min_delta, "unresolved").otherwise("evolution").alias("temporal_status"),
        F.when(delta >= min_delta, F.round(F.least(F.lit(1.0), delta / max(30.0 * min_delta, 30.0)), 3)).otherwise(0.0).alias("temporal_confidence"), F.round(delta, 2).alias("time_delta_days"), "counterpart",
    )
    out = nodes.select("claim_id").distinct().join(found, "claim_id", "left")
    return out.withColumns({"temporal_status": F.coalesce("temporal_status", F.lit("static_partition")), "temporal_confidence": F.coalesce("temporal_confidence", F.lit(0.0))})


def contradiction_days(edges: DataFrame, times: DataFrame) -> DataFrame:
    """edge_id, days between the times of both claims of every contradiction, null where one is missing.  times: (claim_id, ts), one row per claim."""
    t = times.select("claim_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    e = edges.where("relation_type = 'contradicts'").select("edge_id", "source", "target")
    e = e.join(t.select(F.col("claim_id").alias("source"), F.col("us").alias("a")), "source", "left").join(t.select(F.col("claim_id").alias("target"), F.col("us").alias("b")), "target", "left")
    return e.select("edge_id", F.round(F.abs(F.col("a") - F.col("b")) / 86_400_000_000.0, 6).alias("days"))


def supported_contradictions(edges: DataFrame, by: tuple[str, ...] = ("supports",)) -> DataFrame:
    """edge_id, source_supported, target_supported of every contradiction: whether an edge of type `by` points at its ends."""
    supported = edges.where(F.col("relation_type").isin(*by)).select(F.col("target").alias("c")).distinct().withColumn("yes", F.lit(True))
    out = edges.where("relation_type = 'contradicts'").select("edge_id", "source", "target")
    for end in ("source", "target"):
        out = out.join(supported.select(F.col("c").alias(end), F.col("yes").alias(f"{end}_yes")), end, "left")
    return out.select("edge_id", *[F.coalesce(f"{end}_yes", F.lit(False)).alias(f"{end}_supported") for end in ("source", "target")])


def role(is_bridge: Column, centrality: Column, in_degree: Column, out_degree: Column, degree: Column, refines_out: Column) -> Column:
    """Semantic role by the ladder bridge, foundational, evidence hub, refinement root, leaf, peripheral."""
    return (
        F.when(is_bridge, "bridge_claim").when((centrality >= 0.5) & (in_degree >= 2), "foundational_claim").when(in_degree >= 3, "evidence_hub").when(refines_out >= 2, "refinement_root")
        .when(out_degree == 0, "leaf_claim").when(degree <= 1, "peripheral_claim").otherwise("unclassified")
    )


def roles(topo: DataFrame, edges: DataFrame) -> DataFrame:
    refining = edges.where("relation_type = 'refines'").groupBy(F.col("source").alias("claim_id")).agg(F.count("*").alias("refines_out"))
    rows = topo.join(refining, "claim_id", "left").fillna(0, ["refines_out"])
    return rows.withColumn("semantic_role", role(*[F.col(c) for c in ("is_bridge", "centrality", "in_degree", "out_degree", "degree", "refines_out")])).drop("refines_out")


def adjacency(edges: DataFrame) -> DataFrame:
    """claim_id, neighbor, edge_id, relation_type: along every edge, and back where the direction is symmetric."""
    there = edges.select(F.col("source").alias("claim_id"), F.col("target").alias("neighbor"), "edge_id", "relation_type")
    back = edges.where("direction = 'symmetric'").select(F.col("target").alias("claim_id"), F.col("source").alias("neighbor"), "edge_id", "relation_type")
    return there.unionByName(back)


def traverse(nodes: DataFrame, edges: DataFrame, start: str, depth: int, relation_type: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(claim_id, depth), (edge rows recorded on expanding nodes of less than the depth); depth is at most 5, an unknown start gives nothing."""
    depth = max(0, min(depth, 5))
    scratch = Scratch(nodes.sparkSession, "traverse")
    adj = adjacency(edges if relation_type is None else edges.where(F.col("relation_type") == relation_type))
    adj = scratch.table(adj)
    seen = nodes.where(F.col("claim_id") == start).select("claim_id").distinct().withColumn("depth", F.lit(0))
    for i in range(depth):
        new = seen.where(F.col("depth") == i).join(adj, "claim_id").select(F.col("neighbor").alias("claim_id")).distinct().join(seen, "claim_id", "left_anti").withColumn("depth", F.lit(i + 1))
        seen = scratch.table(seen.unionByName(new))
    walked = seen.where(F.col("depth") < depth).join(adj, "claim_id").select("edge_id").distinct()
    return seen, edges.join(walked, "edge_id", "left_semi")


def statistics(nodes: DataFrame, edges: DataFrame, topo: DataFrame, temporal_: DataFrame) -> DataFrame:
    """One row of counts: nodes, edges by type, isolated, bridges, hubs, evolution pairs."""
    e = edges.agg(F.count("*").alias("n_edges"), *[F.count_if(F.col("relation_type") == t).alias(f"n_{t}") for t in TYPES])
    ends = endpoints(edges).withColumn("linked", F.lit(1))
    n = nodes.select("claim_id").distinct().join(ends, "claim_id", "left").agg(F.count("*").alias("n_nodes"), F.count_if(F.col("linked").isNull()).alias("n_isolated"))
    t = topo.agg(F.count_if("is_bridge").alias("n_bridges"), F.count_if("is_hub").alias("n_hubs"))
    v = temporal_.agg(F.floor(F.count_if(F.col("temporal_status") == "evolution") / 2).alias("n_evolution_pairs"))
    return n.crossJoin(e).crossJoin(t).crossJoin(v)  # one row each


def fingerprint(nodes: DataFrame, edges: DataFrame, version: str = "7.0") -> DataFrame:
    """One row: digest of the digests of all ids, order-free and without collecting ids in one place.

    Sixteen hex digits of sha256 over per-bucket digests of sorted ids; nodes first, then edges, then the version.
    """
    keys = nodes.select(F.concat(F.lit("n:"), "claim_id").alias("k")).distinct().unionByName(edges.select(F.concat(F.lit("e:"), "edge_id").alias("k")).distinct())
    bucket = keys.groupBy(F.substring(F.sha2("k", 256), 1, 3).alias("b")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("k")), "|"), 256).alias("d"))
    return bucket.agg(F.substring(F.sha2(F.concat_ws("|", F.array_join(F.array_sort(F.collect_list(F.concat("b", "d"))), "|"), F.lit(version)), 256), 1, 16).alias("fingerprint"))
