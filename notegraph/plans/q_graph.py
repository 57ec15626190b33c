"""Queries of the signed graph."""

from pyspark.sql import functions as F

from notegraph.operators import graph as G
from notegraph.plans import sql
from notegraph.plans.base import RELATEDNESS, graph, parts, times
from notegraph.plans.registry import query
from notegraph.session import table

NODES, EDGES, BASE, COLOUR, KEPT, PARTS, INNER, reach = sql.NODES, sql.GRAPH_EDGES, sql.BASE, sql.COLOUR, sql.KEPT, sql.PARTS, sql.INNER, sql.reach
TOPOLOGY = f"{PARTS}, {INNER}, {sql.TOPOLOGY}"
base = graph


def twice(name, text):
    """Registers f(spark, d, relatedness) as NAME, and as NAME_ungated with contradictions between unrelated texts kept."""

    def add(f):
        query(name, text)(lambda spark, d: f(spark, d, RELATEDNESS))
        query(f"{name}_ungated", None if text is None else sql.ungated(text))(lambda spark, d: f(spark, d, 0.0))
        return f

    return add


@query("g09_edges", f"SELECT * FROM {EDGES}")
def g09(spark, d):
    return base(spark, d)[1].select("edge_id", "source", "target", "relation_type", "direction", "confidence")


@query("g10_problems", f"WITH {BASE} SELECT * FROM (SELECT 'dangling_end' AS problem, count(*) AS n FROM (SELECT source AS x FROM edges UNION ALL SELECT target FROM edges) WHERE x NOT IN (SELECT claim_id FROM nodes) UNION ALL SELECT 'empty_text', count(*) FROM nodes WHERE trim(coalesce(claim_text, '')) = '' UNION ALL SELECT 'unknown_type', count(*) FROM edges WHERE relation_type NOT IN ('supports', 'refines', 'equivalent', 'contradicts', 'neutral') UNION ALL SELECT 'confidence_out_of_range', count(*) FROM edges WHERE NOT coalesce(confidence BETWEEN 0 AND 1, false) UNION ALL SELECT 'repeated_id', count(*) FROM (SELECT claim_id FROM nodes GROUP BY 1 HAVING count(*) > 1))")
def g10(spark, d):
    return G.problems(*base(spark, d))


@query("g10_problems_without_anchors", f"WITH {BASE}, known AS (SELECT claim_id FROM {sql.CLAIMS}) SELECT 'dangling_end' AS problem, count(*) AS n FROM (SELECT source AS x FROM edges UNION ALL SELECT target FROM edges) WHERE x NOT IN (SELECT claim_id FROM known)")
def g10a(spark, d):
    # the graph read without its anchor claims: their edges dangle
    from notegraph.plans.base import claims_of

    return G.problems(claims_of(spark, d), graph(spark, d)[1]).where("problem = 'dangling_end'")


@twice("g02_partitions", f"{PARTS} SELECT claim_id, colour, partition_id FROM parts JOIN colour USING (claim_id)")
def g02(spark, d, relatedness):
    return parts(spark, d, relatedness).select("claim_id", "colour", "partition_id")


@twice("g03_naive_partitions", f"WITH RECURSIVE {BASE}, {reach('parts', 'SELECT source, target FROM edges')} SELECT claim_id, partition_id FROM parts")
def g03(spark, d, relatedness):
    return G.naive_partitions(*base(spark, d, relatedness))


@query("g03_deletion_partitions", f"WITH RECURSIVE {BASE}, {reach('parts', chr(39).join(['SELECT source, target FROM edges WHERE relation_type <> ', 'contradicts', '']))} SELECT claim_id, partition_id FROM parts")
def g03d(spark, d):
    return G.deletion_partitions(*base(spark, d))


@query("g03_weighted_partitions")
def g03w(spark, d):
    return G.weighted_partitions(*base(spark, d))


QUALITY = """SELECT (SELECT count(*) FROM s) AS n_partitions, (SELECT round(avg(CASE WHEN n = 1 THEN 1.0 ELSE 0.0 END::DOUBLE), 6) FROM s) AS singleton_rate, (SELECT round(avg(n), 6) FROM s) AS avg_size, (SELECT max(n) FROM s) AS max_size,
 count(*) FILTER (WHERE a.partition_id = b.partition_id AND relation_type = 'contradicts') AS violations, count(*) FILTER (WHERE a.partition_id = b.partition_id AND relation_type <> 'contradicts') AS retained, count(*) FILTER (WHERE a.partition_id <> b.partition_id AND relation_type <> 'contradicts') AS cut
 FROM edges JOIN parts a ON a.claim_id = source JOIN parts b ON b.claim_id = target"""


@query("a31_quality_naive", f"WITH RECURSIVE {BASE}, {reach('parts', 'SELECT source, target FROM edges')}, s AS (SELECT partition_id, count(*) AS n FROM parts GROUP BY 1) {QUALITY}")
def a31n(spark, d):
    nodes, edges = base(spark, d)
    return G.quality(edges, G.naive_partitions(nodes, edges))


@twice("a31_quality_signed", f"{PARTS}, s AS (SELECT partition_id, count(*) AS n FROM parts GROUP BY 1) {QUALITY}")
def a31(spark, d, relatedness):
    return G.quality(graph(spark, d, relatedness)[1], parts(spark, d, relatedness))


@twice("a31_quality_by_type", f"{PARTS}, both_ends AS (SELECT relation_type, a.partition_id = b.partition_id AS inside FROM edges JOIN parts a ON a.claim_id = source JOIN parts b ON b.claim_id = target) SELECT relation_type, count(*) FILTER (WHERE inside) AS n_inside, count(*) FILTER (WHERE NOT inside) AS n_cut FROM both_ends GROUP BY 1")
def a31t(spark, d, relatedness):
    return G.quality_by_type(graph(spark, d, relatedness)[1], parts(spark, d, relatedness))


@query("g02_partition_table", f"""{PARTS}, {INNER}, sup AS (SELECT DISTINCT source, target FROM inn WHERE relation_type = 'supports' AND source <> target), walk(p, here, path) AS (SELECT partition_id, target, [source, target] FROM inn WHERE relation_type = 'supports' AND source <> target UNION ALL SELECT p, target, list_append(path, target) FROM walk JOIN sup ON source = here WHERE NOT list_contains(path, target)),
 c AS (SELECT p AS partition_id, max(len(path)) AS longest_chain FROM walk GROUP BY 1), e AS (SELECT partition_id, count(*) AS n_edges, count(*) FILTER (WHERE relation_type = 'supports') AS n_supports FROM inn GROUP BY 1), z AS (SELECT partition_id, count(*) AS n_nodes FROM parts GROUP BY 1)
 SELECT partition_id, n_nodes, coalesce(n_edges, 0) AS n_edges, coalesce(n_supports, 0) AS n_supports, coalesce(longest_chain, 0) AS longest_chain, round(coalesce(n_edges, 0)::DOUBLE / CASE WHEN n_nodes = 1 THEN 1 ELSE n_nodes * (n_nodes - 1) END, 6) AS density FROM z LEFT JOIN e USING (partition_id) LEFT JOIN c USING (partition_id)""")
def g02t(spark, d):
    return G.partition_table(graph(spark, d)[1], parts(spark, d))


@query("g04_topology", f"{TOPOLOGY} SELECT claim_id, degree, in_degree, out_degree, centrality, is_hub, is_bridge FROM topo")
def g04(spark, d):
    return G.topology(graph(spark, d)[1], parts(spark, d)).select("claim_id", "degree", "in_degree", "out_degree", "centrality", "is_hub", "is_bridge")


@query("g05_articulation_points", f"{TOPOLOGY} SELECT claim_id FROM bridges")
def g05(spark, d):
    inner = G.placed(graph(spark, d)[1], parts(spark, d)).where("p_source = p_target and relation_type != 'contradicts'")
    return G.articulation_points(inner)


@query("g06_support", f"{PARTS}, {INNER}, {sql.SUPPORT} SELECT s.* REPLACE (round(discounted_confidence, 4) AS discounted_confidence, round(weighted_confidence, 4) AS weighted_confidence), coalesce(l.supporters, '') AS supporters FROM support s LEFT JOIN (SELECT node AS claim_id, string_agg(s, ',' ORDER BY s) AS supporters FROM sup GROUP BY 1) l USING (claim_id)")
def g06(spark, d):
    found = G.support(graph(spark, d)[1], parts(spark, d))
    return found.select("claim_id", "support_count", F.round("weighted_confidence", 4).alias("weighted_confidence"), "discounted_strength", F.round("discounted_confidence", 4).alias("discounted_confidence"), F.size("group_ids").alias("n_groups"), F.array_join("supporting_ids", ",").alias("supporters"))


@twice("g07_contradiction_times", f"SELECT edge_id, round(abs(epoch_us(a.ts) - epoch_us(b.ts)) / 86400000000.0, 6) AS days FROM {EDGES} e LEFT JOIN {sql.TIMES} a ON a.claim_id = source LEFT JOIN {sql.TIMES} b ON b.claim_id = target WHERE relation_type = 'contradicts'")
def g07p(spark, d, relatedness):
    return G.contradiction_days(graph(spark, d, relatedness)[1], times(spark, d))


@twice("g07_temporal", f"WITH {BASE}, {sql.TEMPORAL} SELECT claim_id, temporal_status, temporal_confidence, time_delta_days, counterpart FROM temporal")
def g07(spark, d, relatedness):
    return G.temporal(*graph(spark, d, relatedness), times(spark, d)).select("claim_id", "temporal_status", "temporal_confidence", "time_delta_days", "counterpart")


@query("g08_roles", f"{TOPOLOGY} SELECT claim_id, semantic_role FROM topo")
def g08(spark, d):
    e = graph(spark, d)[1]
    return G.roles(G.topology(e, parts(spark, d)), e).select("claim_id", "semantic_role")


START = "(SELECT source FROM (SELECT source, count(*) AS n FROM edges GROUP BY 1) ORDER BY n DESC, source LIMIT 1)"
WALK = f"WITH RECURSIVE {BASE}, adj AS (SELECT source AS x, target AS y, edge_id FROM edges UNION ALL SELECT target, source, edge_id FROM edges WHERE direction = 'symmetric'), w(claim_id, depth) AS (SELECT {START}, 0 UNION SELECT y, depth + 1 FROM w JOIN adj ON x = claim_id WHERE depth < 3)"


def start(edges):
    return edges.groupBy("source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source").first()[0]


@query("g01_traverse_nodes", f"{WALK} SELECT claim_id, min(depth) AS depth FROM w GROUP BY 1")
def g01(spark, d):
    nodes, edges = base(spark, d)
    return G.traverse(nodes, edges, start(edges), 3)[0]


@query("g01_traverse_edges", f"{WALK} SELECT DISTINCT edge_id FROM (SELECT claim_id, min(depth) AS depth FROM w GROUP BY 1) JOIN adj ON x = claim_id WHERE depth < 3")
def g01e(spark, d):
    nodes, edges = base(spark, d)
    return G.traverse(nodes, edges, start(edges), 3)[1].select("edge_id")


@query("g11_neighbors", f"WITH {BASE} SELECT claim_id, count(DISTINCT other) AS n_neighbors FROM (SELECT source AS claim_id, target AS other FROM edges UNION ALL SELECT target, source FROM edges) GROUP BY 1")
def g11(spark, d):
    _, e = base(spark, d)
    both = e.select(F.col("source").alias("claim_id"), F.col("target").alias("other")).unionByName(e.select(F.col("target").alias("claim_id"), F.col("source").alias("other")))
    return both.groupBy("claim_id").agg(F.count_distinct("other").alias("n_neighbors"))


@query("j10_support_contradict_support", sql.ungated(f"WITH {BASE} SELECT edge_id, source IN (SELECT target FROM edges WHERE relation_type IN ('supports', 'refines')) AS source_supported, target IN (SELECT target FROM edges WHERE relation_type IN ('supports', 'refines')) AS target_supported FROM edges WHERE relation_type = 'contradicts'"))
def j10(spark, d):
    return G.supported_contradictions(graph(spark, d, 0.0)[1], ("supports", "refines"))


@query("a05_edge_counts", f"WITH {BASE} SELECT relation_type, count(*) AS n, (SELECT count(*) FROM nodes WHERE claim_id NOT IN (SELECT source FROM edges UNION SELECT target FROM edges)) AS n_isolated FROM edges GROUP BY 1")
def a05(spark, d):
    nodes, e = base(spark, d)
    lonely = nodes.join(G.endpoints(e), "claim_id", "left_anti").agg(F.count("*").alias("n_isolated"))
    return e.groupBy("relation_type").agg(F.count("*").alias("n")).crossJoin(lonely)


@query("a05_graph_statistics", f"""{TOPOLOGY}, {sql.TEMPORAL} SELECT (SELECT count(*) FROM nodes) AS n_nodes, (SELECT count(*) FROM nodes WHERE claim_id NOT IN (SELECT source FROM edges UNION SELECT target FROM edges)) AS n_isolated, count(*) AS n_edges,
 {", ".join(f"count(*) FILTER (WHERE relation_type = '{t}') AS n_{t}" for t in G.TYPES)}, (SELECT count(*) FROM topo WHERE is_bridge) AS n_bridges, (SELECT count(*) FROM topo WHERE is_hub) AS n_hubs, (SELECT count(*) FROM temporal WHERE temporal_status = 'evolution') // 2 AS n_evolution_pairs FROM edges""")
def a05s(spark, d):
    nodes, e = graph(spark, d)
    return G.statistics(nodes, e, G.topology(e, parts(spark, d)), G.temporal(nodes, e, times(spark, d)))


@query("a39_fingerprint", f"WITH {BASE}, k AS (SELECT DISTINCT 'n:' || claim_id AS k FROM nodes UNION ALL SELECT DISTINCT 'e:' || edge_id FROM edges), b AS (SELECT left(sha256(k), 3) AS b, sha256(string_agg(k, '|' ORDER BY k)) AS d FROM k GROUP BY 1) SELECT left(sha256(string_agg(b || d, '|' ORDER BY b || d) || '|7.0'), 16) AS fingerprint FROM b")
def a39(spark, d):
    return G.fingerprint(*base(spark, d))
