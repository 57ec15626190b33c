"""Operators against small fixtures with known answers."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from notegraph import config
from notegraph.functions import blocks as B
from notegraph.functions import text as T
from notegraph.operators import evaluation as E
from notegraph.operators import graph as G
from notegraph.operators import pipeline, scoring
from notegraph.operators import predicates as P
from notegraph.operators import relations as R
from notegraph.operators import similarity as S
from notegraph.operators import statistics as A
from notegraph.plans import requests as Q
from notegraph.sources import files, sinks
from notegraph.streaming import incremental

EDGE = "edge_id string, source string, target string, relation_type string, direction string, confidence double"


def graph(spark, edges, extra=()):
    rows = [(f"e{i:02d}", a, b, t, "symmetric" if t in ("contradicts", "equivalent") else "a_to_b", c) for i, (a, b, t, c) in enumerate(edges)]
    ids = sorted({x for _, a, b, *_ in rows for x in (a, b)} | set(extra))
    return spark.createDataFrame([(i, f"text {i}") for i in ids], "claim_id string, claim_text string"), spark.createDataFrame(rows, EDGE)


def rows(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def test_predicates_on_null_and_types(spark):
    df = spark.createDataFrame([("a", None, 1.0), ("b", "x", None), ("c", "y", 3.0)], "claim_id string, context string, degree double")
    ask = lambda *p: [r[0] for r in P.where_all(df, list(p)).orderBy("claim_id").collect()]
    assert ask(P.Predicate("context", "eq", None)) == ["a"]
    assert ask(P.Predicate("context", "neq", "x")) == ["a", "c"]
    assert ask(P.Predicate("degree", "gt", 0)) == ["a", "c"]
    assert ask(P.Predicate("degree", "gt", "0")) == []
    assert ask(P.Predicate("context", "in", ["x", None])) == ["a", "b"]
    assert ask(P.Predicate("context", "in", [])) == []
    with pytest.raises(ValueError):
        ask(P.Predicate("context", "like", "x"))


def test_scan_pages_and_ties(spark):
    df = spark.createDataFrame([(f"c{i}", "T", float(i % 2)) for i in range(6)], "claim_id string, claim_text string, degree double")
    page, total = P.scan(df, [], P.Sort("degree", True), P.Page(2, 1), "t")
    assert [r[0] for r in page.collect()] == ["c3", "c5"] and total.first()[0] == 6


def test_resolver_cases(spark):
    def row(i, ab, ba):
        return (i, "a", "b", 0.9, 1, *ab, *(ba or (None, None, None)), max(ab), max(ba) if ba else None, "m")

    data = [row("s", (0.9, 0.05, 0.05), (0.1, 0.85, 0.05)), row("b", (0.1, 0.85, 0.05), (0.9, 0.05, 0.05)), row("e", (0.9, 0.05, 0.05), (0.8, 0.1, 0.1)), row("c", (0.05, 0.05, 0.9), (0.05, 0.1, 0.85)), row("n", (0.2, 0.7, 0.1), (0.5, 0.2, 0.3)), row("u", (0.5, 0.3, 0.2), (0.5, 0.3, 0.2)), row("1", (0.85, 0.1, 0.05), None)]
    df = spark.createDataFrame(data, "relationship_id string, claim_id_a string, claim_id_b string, cosine_similarity double, candidate_rank int, e_ab double, n_ab double, c_ab double, e_ba double, n_ba double, c_ba double, conf_ab double, conf_ba double, model_name string")
    out = {r["relationship_id"]: (r["relation_type"], r["direction"]) for r in R.resolve(df).collect()}
    assert out == {"s": ("supports", "a_to_b"), "b": ("supports", "b_to_a"), "e": ("equivalent", "symmetric"), "c": ("contradicts", "symmetric"), "n": ("neutral", "symmetric"), "u": ("unknown", "symmetric"), "1": ("supports", "a_to_b")}
    with pytest.raises(ValueError):
        R.ResolverPolicy(priority=("contradicts",))


def test_diamond_and_hops(spark):
    nodes, edges = graph(spark, [("A", "B", "supports", 0.9), ("A", "C", "supports", 0.85), ("B", "D", "supports", 0.88), ("C", "D", "supports", 0.88)])
    parts = G.partitions(nodes, edges)
    d = {r["claim_id"]: r for r in G.support(edges, parts).collect()}
    assert d["D"]["support_count"] == 3 and d["D"]["supporting_ids"] == ["A", "B", "C"] and d["A"]["support_count"] == 0
    nodes, edges = graph(spark, [("A", "D", "supports", 0.9), ("E", "A", "supports", 0.9), ("F", "E", "supports", 0.9)])
    d = {r["claim_id"]: r for r in G.support(edges, G.partitions(nodes, edges)).collect()}["D"]
    assert (d["direct"], d["derived"], d["multi_hop"], d["discounted_strength"]) == (["A"], ["E"], ["F"], 1.9)
    table = G.partition_table(edges, G.partitions(nodes, edges)).first()
    assert table["longest_chain"] == 4 and table["n_nodes"] == 4


def test_contradictions_never_share_a_partition(spark):
    nodes, edges = graph(spark, [("A", "B", "contradicts", 0.9), ("A", "X", "supports", 0.9), ("B", "X", "supports", 0.9)], ["lonely"])
    p = {r["claim_id"]: r["partition_id"] for r in G.partitions(nodes, edges).collect()}
    assert p["A"] != p["B"] and len(set(p.values())) == 3
    nodes, edges = graph(spark, [("A", "B", "contradicts", 0.9), ("B", "C", "contradicts", 0.9), ("C", "A", "contradicts", 0.9), ("D", "A", "supports", 0.9)])
    assert G.partitions(nodes, edges).select("partition_id").distinct().count() == 4
    assert G.quality(edges, G.naive_partitions(nodes, edges)).first()["violations"] == 3
    w = G.weighted_partitions(nodes, edges)
    assert G.quality(edges, w).first()["violations"] <= 1


def test_random_graphs_against_plain_python(spark):
    rng = random.Random(3)
    ids = [f"n{i:02d}" for i in range(24)]
    pairs = [(*rng.sample(ids, 2), rng.choice(["supports", "equivalent", "contradicts"]), 0.9) for _ in range(26)]
    nodes, edges = graph(spark, pairs, ids)
    near = {i: set() for i in ids}
    for a, b, *_ in pairs:
        near[a].add(b)
        near[b].add(a)

    def reach(start, without=None):
        seen, todo = {start}, [start]
        while todo:
            for b in near[todo.pop()] - seen - {without}:
                seen.add(b)
                todo.append(b)
        return seen

    from notegraph.lineage import Scratch

    got = dict(rows(G.components(nodes, edges, Scratch(spark, "t")), "claim_id", "component"))
    assert got == {i: min(reach(i)) for i in ids}
    cut = set(G._articulation([(a, b) for a, b, *_ in pairs]))
    want = {i for i in ids if any(y not in reach(x, i) for x, y in itertools.combinations(sorted(near[i]), 2))}
    assert cut == want
    seen, walked = G.traverse(nodes, edges, pairs[0][0], 2)
    assert seen.where("depth = 0").count() == 1 and seen.agg(F.max("depth")).first()[0] <= 2
    assert G.traverse(nodes, edges, "nobody", 2)[0].count() == 0 and walked.count() >= 0


def test_empty_graph(spark):
    nodes, edges = graph(spark, [], [])
    parts = G.partitions(nodes, edges)
    assert parts.count() == 0 and G.topology(edges, parts).count() == 0 and G.support(edges, parts).count() == 0


def test_temporal(spark):
    nodes, edges = graph(spark, [("A", "B", "contradicts", 0.9), ("C", "D", "contradicts", 0.9), ("E", "F", "contradicts", 0.9)], ["G"])
    times = spark.createDataFrame([("A", "2024-01-01"), ("B", "2024-01-11"), ("C", "2024-01-01 00:00:00"), ("D", "2024-01-01 05:00:00")], "claim_id string, t string").select("claim_id", F.to_timestamp("t").alias("ts"))
    out = {r["claim_id"]: r for r in G.temporal(nodes, edges, times).collect()}
    assert out["A"]["temporal_status"] == "evolution" and out["A"]["temporal_confidence"] == 0.333 and out["B"]["time_delta_days"] == 10.0
    assert out["C"]["temporal_status"] == "unresolved" and out["E"]["temporal_status"] == "no_timestamp" and out["G"]["temporal_status"] == "static_partition"


RAW = "claim_id string, evidence_strength double, evidence_independence double, source_diversity double, topology_strength double, hub_score double, bridge_score double, conflict_pressure double, temporal_stability double"


def test_scores_caps_and_monotonicity(spark):
    base = [0.8, 0.8, 0.8, 0.5, 0.0, 0.0, 0.0, 0.5]
    change = lambda **k: [k.get(s, v) for s, v in zip(scoring.SIGNALS, base, strict=True)]
    data = {"base": base, "more": change(evidence_strength=0.9), "conflict": change(conflict_pressure=0.5), "capped": change(conflict_pressure=0.95, evidence_strength=1.0), "none": change(evidence_strength=0.05), "nan": change(source_diversity=float("nan")), "null": change(source_diversity=None)}
    out = {r["claim_id"]: r for r in scoring.explain(scoring.score(spark.createDataFrame([(k, *v) for k, v in data.items()], RAW))).collect()}
    ri = {k: r["reliability_index"] for k, r in out.items()}
    assert ri["more"] > ri["base"] > ri["conflict"] and ri["capped"] <= 40 and ri["none"] <= 60 and ri["nan"] == ri["null"] < ri["base"]
    assert out["null"]["evidence_completeness"] == 7 / 8 and out["conflict"]["limiting_signal"] == "conflict_pressure"
    assert max(ri.values()) <= 75.0001
    again = scoring.score(spark.createDataFrame([(k, *v) for k, v in data.items()], RAW))
    assert scoring.reconstruct(again).where("not exact").count() == 0
    for p in scoring.PROFILES:
        assert abs(sum(scoring.weights(p).values()) - 1) < 1e-9


EDGES_TEXT = "﻿---\ndate: 2024-01-05\n---\n\n# Top\n\nOne para.   \r\nSecond line e.g. Dr. Smith at 3.14 m. Next one!\n\n\n\n\n\n## Sub\n\n- item one\n* item two.\n1. first\n\n> quoted\n> more\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\nSet\n===\n\n***\n\n```py\n# no heading\n\n- no item\n"


def test_normalisation_and_blocks(spark):
    df = spark.createDataFrame([(1, EDGES_TEXT), (2, None), (3, "")], "doc_id long, text string")
    out = {r["doc_id"]: r for r in T.normalize(df).collect()}
    assert out[1]["warnings"] == ["bom_removed", "line_endings", "trailing_blanks", "blank_lines", "outer_blank_lines"]
    assert out[2]["normalized_text"] is None and out[2]["warnings"] == [] and out[3]["warnings"] == ["low_text"]
    again = T.normalize(spark.createDataFrame([(1, out[1]["normalized_text"])], "doc_id long, text string")).first()
    assert again["normalized_text"] == out[1]["normalized_text"] and again["warnings"] == []
    t = out[1]["normalized_text"]
    kinds = [b.kind for b in B.scan(t)]
    assert kinds == ["front_matter", "heading", "paragraph", "heading", "bullet_item", "bullet_item", "ordered_item", "block_quote", "table", "heading", "horizontal_rule", "code_block"]
    for b in B.scan(t):
        assert 0 <= b.start < b.end <= len(t)
    assert B.prose("bullet_item", "item one") == "item one." and B.prose("table", "| a | b |\n|---|---|\n| 1 | 2 |") == "a: 1. b: 2."
    assert B.scan("---\nno end") [0].kind == "horizontal_rule"
    s = "Dr. Smith saw 3.14 m. Next one... or so! \"Really?\" Yes"
    assert [s[a:b] for a, b in B.split_sentences(s)] == ["Dr. Smith saw 3.14 m.", "Next one... or so!", '"Really?"', "Yes"]
    table = B.sentences(B.block_table(df.where("doc_id = 1")))
    assert table.where("context = 'Top > Sub'").count() >= 5 and table.select("sentence_id").distinct().count() == table.count()


def test_top_k_pairs_matches_plain(spark):
    rng = random.Random(1)
    data = [(i, [rng.gauss(0, 1) for _ in range(5)]) for i in range(40)] + [(40, None)]
    df = spark.createDataFrame(data, "id long, v array<double>")
    got = {(r["a"], r["b"]): r["rank"] for r in S.top_k_pairs(df, "id", "v", 3, -99.0, block=16).collect()}
    for i, v in data[:40]:
        best = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), j) for j, w in data[:40] if j != i)[:3]
        assert [got[i, j] for _, j in best] == [1, 2, 3]
    assert S.top_k_pairs(df.where("id = 40"), "id", "v").count() == 0
    # clusters far apart, one of which holds most rows: pruned pairs of pieces lose nothing
    centers = [[10.0 * (i == j) for j in range(5)] for i in range(5)]
    data = [(i, [c + rng.gauss(0, 1) for c in centers[0 if i % 3 else i % 5]]) for i in range(90)]
    unit = [(i, [x / math.sqrt(sum(y * y for y in v)) for x in v]) for i, v in data]
    for scaled in (unit, data):
        least = 0.95 if scaled is unit else 95.0
        got = {(r["a"], r["b"]): r["score"] for r in S.top_k_pairs(spark.createDataFrame(scaled, "id long, v array<double>"), "id", "v", 100, least, block=8).collect()}
        want = {(i, j): s for i, v in scaled for j, w in scaled if i != j and (s := sum(x * y for x, y in zip(v, w, strict=True))) >= least}
        assert set(got) == set(want) and want and all(abs(got[p] - want[p]) < 1e-6 for p in want)


def test_hot_keys_are_joined_by_their_few_rows(spark):
    from notegraph.operators.joins import salted, split_hot

    many = spark.range(5000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 700).cast("string"))).alias("k")).unionByName(spark.createDataFrame([(-1, None), (-2, "nowhere")], "id long, k string"))
    few = many.where("k is not null and k != 'nowhere'").select("k").distinct().withColumn("v", F.length("k"))
    want = rows(many.join(few, "k"), "id", "v")
    assert rows(split_hot(many, few, "k", least=100), "id", "v") == want == rows(salted(many, few, ["k"], "id"), "id", "v")
    assert split_hot(many.limit(0), few, "k").count() == 0


def test_salted_copies_are_not_broadcast(spark):
    from notegraph.operators.joins import salted

    many, few = spark.range(1000).select("id", (F.col("id") % 3).alias("k")), spark.range(3).select(F.col("id").alias("k"), F.lit("v").alias("v"))
    joined = salted(many, few, ["k"], "id")
    assert joined.count() == 1000
    assert "Broadcast" not in joined._jdf.queryExecution().executedPlan().toString()


def test_longest_path():
    rng = random.Random(8)
    for n in (3, 6, 8):
        for _ in range(20):
            edges = {(str(a), str(b)) for a, b in (rng.sample(range(n), 2) for _ in range(n)) if rng.random() < 0.8}
            best = max((len(p) for k in range(2, n + 1) for p in itertools.permutations([str(i) for i in range(n)], k) if all(e in edges for e in zip(p, p[1:]))), default=0) if n < 8 else None
            got = G._longest_path(edges)
            assert got == best or best is None and got <= n
    assert G._longest_path({(str(i), str(i + 1)) for i in range(3000)} | {("0", str(i)) for i in range(2, 3000)}) == 3001


def interval(values, level=0.95, resamples=2000, seed=42):
    """The interval by drawing row by row."""
    rng = random.Random(seed)
    n = len(values)
    means = sorted(sum(values[rng.randrange(n)] for _ in range(n)) / n for _ in range(resamples))
    return means[int((1 - level) / 2 * resamples)], means[min(resamples - 1, int((1 + level) / 2 * resamples))]


def test_bootstrap_interval_matches_the_reference_distribution(spark):
    values = [float(i % 10 < 7) for i in range(200)]
    df = spark.createDataFrame([(v, str(i // 4)) for i, v in enumerate(values)], "v double, g string")
    lo, hi = interval(values)
    r = E.bootstrap(df, "v").first()
    assert abs(r["ci_low"] - lo) < 0.02 and abs(r["ci_high"] - hi) < 0.02 and r["estimate"] == 0.7
    assert E.bootstrap(df, "v", "g").first()["n"] == 200


def test_ranks_within_one_hot_group(spark):
    """A group and a value that hold nearly all rows are cut into slices, and ranks stay exact."""
    rng = random.Random(4)
    data = [(None if i % 40 == 0 else "hot" if i % 20 else "cold", None if i % 50 == 49 else 7.0 if i % 3 else rng.random() * 10, i % 7 < 5, f"k{i:04d}") for i in range(2000)]
    df = spark.createDataFrame(data, "g string, v double, ok boolean, k string")
    got = {r["g"]: tuple(r)[1:] for r in A.latency(df, "g", "v").collect()}
    for g in (None, "hot", "cold"):
        vs = sorted(v for a, v, *_ in data if a == g and v is not None)
        assert got[g] == (len(vs), *[vs[min(int(len(vs) * p), len(vs) - 1)] for p in (0.5, 0.95, 0.99)])
    curve = {r["point"]: (r["coverage"], r["risk"]) for r in E.risk_coverage(df.where("v is not null"), "v", "ok", "k").collect()}
    order = sorted((x for x in data if x[1] is not None), key=lambda x: (-x[1], x[3]))
    for i in range(1, 21):
        r = max(1, round(i * len(order) / 20))
        assert curve[i] == (round(r / len(order), 6), round(sum(not x[2] for x in order[:r]) / r, 6))
    assert E.stratified_sample(df, "g", "k", 300).groupBy("g").count().count() == 3 and E.stratified_sample(df, "g", "k", 300).count() == 300
    assert A.latency(df.limit(0), "g", "v").count() == 0 and E.risk_coverage(df.limit(0), "v", "ok", "k").count() == 0 and E.bootstrap(df.limit(0), "v").first()["n"] == 0


def test_assessments(spark):
    ranked = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("q", "a", 3), ("p", "z", 1)], "query string, item string, rank int")
    rel = spark.createDataFrame([("q", "b"), ("q", "c"), ("p", "y"), ("p", None)], "query string, item string")
    r = E.retrieval_benchmark(ranked, rel, 2).first()
    assert (r["n_queries"], r["precision"], r["recall"], r["mrr"]) == (2, 0.25, 0.25, 0.25)
    cov = E.coverage_index(spark.createDataFrame([("experiments", 5, 5), ("claims", 1, 2), ("other", 1, 1)], "component string, present long, expected long")).first()
    assert cov["coverage"] == 42.5 and cov["n_missing"] == 5
    a = {r["claim"]: (r["score"], r["level"]) for r in E.claim_assessment(spark.createDataFrame([("x", 0.9, 0), ("x", 0.8, 1), ("y", None, 0)], "claim string, score double, conflicts int")).collect()}
    assert a == {"x": (0.75, "partly supported"), "y": (None, "unsupported")}
    ready = lambda *s: E.readiness(spark.createDataFrame([(str(i), x) for i, x in enumerate(s)], "criterion string, share double")).first()["level"]
    assert ready(1.0, 1.0) == "ready" and ready(1.0, 0.5) == "in progress" and ready(0.0, None) == "not ready"
    dirs = spark.createDataFrame([("SUPPORTS", "A_TO_B", "SUPPORTS", "A_CONFIRMS_B"), ("REFINES", "A_TO_B", "SUPPORTS", "a_to_b "), ("NEUTRAL", None, "NEUTRAL", None), ("SUPPORTS", "B_TO_A", None, None)], "gold_label string, gold_direction string, label string, direction string")
    assert {r["metric"]: (r["n"], r["k"]) for r in E.direction_metrics(dirs).collect()} == {"D1": (3, 1), "D2": (3, 2), "D3": (4, 2), "D4": (1, 1)}
    flat = spark.createDataFrame([(1.0, 1.0), (1.0, 2.0)], "a double, b double")
    assert E.pearson(flat, "a", "b").first()[0] == 0.0 and E.pearson(flat, "a", "a").first()[0] == 1.0


def test_quotas_sum(spark):
    df = spark.createDataFrame([(c, i) for c, n in (("a", 7), ("b", 3), ("c", 1)) for i in range(n)], "category string, id int")
    assert E.quotas(df, "category", 5).agg(F.sum("quota")).first()[0] == 5
    assert E.stratified_sample(df, "category", "id", 5).count() == 5


def test_files_roundtrip(spark, tmp_path):
    (tmp_path / "vault" / ".hidden").mkdir(parents=True)
    v = tmp_path / "vault"
    (v / "a.md").write_bytes(b"# A\n\n**Source:** Somewhere\n\nText one.\n")
    (v / "b.md").write_bytes(b"# A\n\n**Source:** Somewhere\n\nText one.\n")
    (v / "c.txt").write_bytes("caf\xe9 text\r\nmixed\n".encode("latin-1"))
    (v / "d.png").write_bytes(b"x")
    (v / "e.md").write_bytes(b"")
    (v / ".hidden" / "f.md").write_bytes(b"hidden")
    found = files.discover(spark, [str(v)])
    assert sorted((r["relative_path"], r["rejection_reason"]) for r in found.collect()) == [("a.md", None), ("b.md", None), ("c.txt", None), ("d.png", "unsupported_extension")]
    docs = {r["path"].rsplit("/", 1)[1]: r for r in files.documents(found).collect()}
    assert set(docs) == {"a.md", "c.txt"} and docs["a.md"]["source"] == "Somewhere" and docs["c.txt"]["encoding"] == "latin-1" and "café" in docs["c.txt"]["normalized_text"]
    with pytest.raises(files.DiscoveryError):
        files.validate_roots([str(v / "nothing")])
    store = sinks.PhaseStore(tmp_path / "out", "1")
    store.write(1, found.drop("content"))
    assert store.resume_from(spark) == 2 and store.read(spark, 1).count() == 4
    assert store.replay(spark, 1, lambda: found.drop("content")) and not store.replay(spark, 1, lambda: found.drop("content").limit(2))
    assert files.decode_bytes("grüß dich".encode("utf-16-le")) == ("grüß dich", "utf-16", False) and files.decode_bytes("grüß".encode("utf-16-be"))[1] == "utf-16"
    twice = files.duplicates(found.select("path", "hash"))
    assert twice.where("is_canonical").count() == 3 and twice.count() == 4
    assert incremental.changed_files(found.select("path", "hash"), found.where("relative_path = 'a.md'").select("path", "hash")).count() == 3


def test_scratch_is_cleaned_up(spark):
    from notegraph import lineage

    t = lineage.Scratch(spark, "once").table(spark.range(3))
    assert t.count() == 3 and lineage.exists(spark, t._scratch_path)
    kept = dict(lineage._ROOTS)
    lineage._ROOTS.clear()
    lineage._ROOTS[t._scratch_path.rsplit("/", 1)[0]] = (spark, spark.sparkContext.applicationId)
    lineage.clean_up(spark)
    assert not lineage.exists(spark, t._scratch_path) and not lineage._ROOTS
    lineage._ROOTS.update(kept)


def test_file_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.md").write_text("same")
    (tmp_path / "in" / "b.md").write_text("same")
    q = incremental.ingest_stream(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("ingested").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("ingested").count() == 1


def test_service(spark, tmp_path):
    claims = spark.createDataFrame([(f"c{i}", f"Text {i} about relays", "ctx", f"d{i % 3}", f"v/{i}.md", "STRUCTURED", False, "certain", None) for i in range(6)], "claim_id string, text string, context string, document_id string, source_path string, extraction_mode string, is_negated boolean, modality string, claim_ts timestamp")
    s = "struct<entailment_score:double,neutral_score:double,contradiction_score:double>"
    ev = spark.createDataFrame([("r1", "c0", "c1", 0.9, 1, (0.9, 0.05, 0.05), None, 0.9, None, "m"), ("r2", "c2", "c1", 0.9, 1, (0.9, 0.05, 0.05), None, 0.9, None, "m"), ("r3", "c3", "c4", 0.9, 1, (0.05, 0.05, 0.9), (0.05, 0.05, 0.9), 0.9, 0.9, "m")], f"relationship_id string, claim_id_a string, claim_id_b string, cosine_similarity double, candidate_rank int, ab {s}, ba {s}, conf_ab double, conf_ba double, model_name string")
    svc = Q.KnowledgeService(pipeline.build(claims, ev))
    one = svc.execute(Q.Search((P.Predicate("support_count", "gte", 1),), "RELAYS", P.Sort("reliability_index", True)))
    assert one["rows"].count() == 1 and one["total"].first()[0] == 1 and one["rows"].first()["claim_id"] == "c1"
    svc.execute(Q.Search((P.Predicate("support_count", "gte", 1),), " RELAYS ", P.Sort("reliability_index", True)))
    assert svc.cache.hits == 1
    assert svc.execute(Q.Lookup("c3", "summary")).count() == 1
    assert svc.execute(Q.Explanation("c1", 3)).first()["summary"].startswith("Index ")
    assert svc.execute(Q.Traversal("c0", 1))["nodes"].count() == 2
    assert svc.execute(Q.Aggregation())["overview"].first()["n_claims"] == 6
    for form in Q.EXPORT_FORMS:
        assert svc.execute(Q.Export(form=form)).count() >= 6
    with pytest.raises(Q.ClaimNotFound):
        svc.execute(Q.Lookup("zz"))
    for bad in (Q.Lookup(" "), Q.Search((P.Predicate("nope", "eq", 1),)), Q.Search(page=P.Page(0)), Q.Traversal("c0", 9), Q.Explanation("c0", 7), Q.Export(form="xml")):
        with pytest.raises(Q.RequestError):
            svc.execute(bad)
    a = Q.plan(Q.Search((P.Predicate("degree", "gt", 1), P.Predicate("claim_id", "eq", "x"))))
    b = Q.plan(Q.Search((P.Predicate("claim_id", "eq", "x"), P.Predicate("degree", "gt", 1))))
    assert a.plan_id == b.plan_id
    with pytest.raises(Q.RequestError):
        Q.Guards().check(depth=9)


def test_config(tmp_path):
    (tmp_path / "x.json").write_text('{"retrieval": {"top_k": 5}}')
    c = config.load(tmp_path / "x.json", tmp_path / "missing.json")
    assert config.get(c, "retrieval.top_k") == 5 and config.get(c, "retrieval.threshold") == 0.75 and config.get(c, "a.b", 1) == 1


def test_entry_without_llm(spark):
    import __spark_entry__ as e

    assert e.entry(spark).limit(1).count() >= 0
    names = set(e.queries())
    assert set(e.oracle_sql()) <= names and len(names) > 130


SAMPLE = ["f05_search_page", "g02_partitions", "k11_fusion_balanced", "a17_prf", "n01_normalized", "j01_top_k"]


@pytest.mark.parametrize("name", SAMPLE)
def test_oracle(spark, name):
    import check_oracle as C

    import __spark_entry__ as e

    d = "/root/testdata/sf0.001"
    assert C.compare(spark, C.connect(d), name, e.queries()[name], e.oracle_sql()[name], d) == ""


def scored_dir(spark, path):
    """Tables of six claims: a supports b supports c, d supports c, c contradicts e; f stands alone.  a and b share a document."""
    s = "struct<entailment_score:double,neutral_score:double,contradiction_score:double>"
    docs = {"a": "d0", "b": "d0", "c": "d1", "d": "d2", "e": "d3", "f": "d4"}
    claims = [(x, f"The claim {x}", None, k, f"v/{k}.md", "STRUCTURED", False, "certain", None) for x, k in docs.items()]
    yes, no = (0.9, 0.05, 0.05), (0.05, 0.05, 0.9)
    ev = [("r1", "a", "b", 0.9, 1, yes, None, 0.9, None, "m"), ("r2", "b", "c", 0.9, 1, yes, None, 0.9, None, "m"), ("r3", "d", "c", 0.9, 1, yes, None, 0.9, None, "m"), ("r4", "c", "e", 0.9, 1, no, no, 0.9, 0.9, "m")]
    for name, df in {
        "claims": spark.createDataFrame(claims, "claim_id string, text string, context string, document_id string, source_path string, extraction_mode string, is_negated boolean, modality string, claim_ts timestamp"),
        "relationship_evidence": spark.createDataFrame(ev, f"relationship_id string, claim_id_a string, claim_id_b string, cosine_similarity double, candidate_rank int, ab {s}, ba {s}, conf_ab double, conf_ba double, model_name string"),
        "anchor_claims": spark.createDataFrame([("g", "The anchor g")], "claim_id string, text string"),
        "documents": spark.createDataFrame([(k, "Web", k, None) for k in sorted(set(docs.values()))], "doc_key string, source string, notebook_id string, modified_at timestamp"),
    }.items():
        df.write.parquet(f"{path}/{name}.parquet")
    return str(path)


def test_record_queries_over_the_scored_graph(spark, tmp_path):
    from notegraph.plans.catalog import QUERIES

    d = scored_dir(spark, tmp_path / "in")
    ask = lambda name: {r["claim_id"]: r for r in QUERIES[name](spark, d).collect()}
    records = ask("f08_projection_standard")
    # c has b and d at one hop and a at two
    assert set(records) == set("abcdefg") and records["c"]["support_count"] == 3
    strength = 0.7 * math.log1p(1 + 1 + 0.6) / math.log1p(3) + 0.3 * 0.9
    independence = (0.5 * 2 + 0.5 * 1) / 3  # two documents and one publisher of three supporters
    conflict = 0.7 + 0.3 * 0.9
    # a has no support, whose independence is then unknown: only its stable time counts
    want = {"a": 100 * 0.05 * 0.5 / 0.8, "c": 100 * (0.25 * strength + 0.15 * independence + 0.15 * 1 - 0.20 * conflict) / 0.8, "e": 0.0}
    assert {x: round(records[x]["reliability_index"], 6) for x in want} == {x: round(v, 6) for x, v in want.items()}
    assert records["e"]["calibration_label"] == "very_low"
    audit = ask("f08_projection_full_audit")
    assert set(audit) == {"b", "c"} and audit["c"]["component_scores"] == 5 and audit["c"]["audit_run_id"] == "run" and audit["c"]["has_summary"]
    with pytest.raises(ValueError, match="partition_id"):
        P.project(spark.createDataFrame([("a", "t")], "claim_id string, claim_text string"), "standard")


def test_gates_and_projection_of_relations(spark):
    """Contradictions of texts about nothing in common are not believed; a support by a clearly more specific claim refines."""
    s = "struct<entailment_score:double,neutral_score:double,contradiction_score:double>"
    yes, no = (0.9, 0.05, 0.05), (0.05, 0.05, 0.9)
    texts = {"a": "Relay stations failed", "b": "Cooks enjoy soup", "c": "Relay stations work", "d": "In March 1999 relay stations of Korvel failed 12 times", "e": None}
    nodes = spark.createDataFrame(list(texts.items()), "claim_id string, claim_text string")
    ev = [("r1", "a", "b", no), ("r2", "a", "c", no), ("r3", "d", "a", yes), ("r4", "a", "d", yes), ("r5", "a", "e", no), ("r6", "a", "zz", yes)]
    evidence = spark.createDataFrame([(i, x, y, 0.9, 1, v, no if v == no else None, 0.9, 0.9 if v == no else None, "m") for i, x, y, v in ev], f"relationship_id string, claim_id_a string, claim_id_b string, cosine_similarity double, candidate_rank int, ab {s}, ba {s}, conf_ab double, conf_ba double, model_name string")
    got = {(r["claim_id_a"], r["claim_id_b"]): r["relation_type"] for r in pipeline.typed_relations(nodes, evidence).collect()}
    assert got == {("a", "c"): "contradicts", ("d", "a"): "refines", ("a", "d"): "supports"}
    assert pipeline.typed_relations(nodes, evidence, relatedness=0.0).count() == 5


def test_specificity_of_all_claims(spark, tmp_path):
    from notegraph.plans.catalog import QUERIES

    rows = [("a", "The relay failed 3 times"), ("b", "The relay in Zürich failed 3 times"), ("c", "“Relay” failed in Mai 1999"), ("d", None)]
    full = [(i, t, None, "d", "p", "STRUCTURED", False, "certain") for i, t in rows]
    spark.createDataFrame(full, "claim_id string, text string, context string, document_id string, source_path string, extraction_mode string, is_negated boolean, modality string").write.parquet(str(tmp_path / "claims.parquet"))
    got = {r[0]: r[1] for r in QUERIES["r09_specificity"](spark, str(tmp_path)).collect()}
    # a: relay, failed, times + one number; b: also "rich" of Zürich and its capital Z; c: relay, failed, 1999 + number + year + Mai
    assert got == {"a": 5.0, "b": 7.5, "c": 8.5, "d": 0.0}


def test_score_queries_over_real_signals(spark, tmp_path):
    from notegraph.plans.catalog import QUERIES

    d = scored_dir(spark, tmp_path / "in")
    got = {r["claim_id"]: r for r in QUERIES["k15_explanations"](spark, d).collect()}
    assert set(got) == set("abcdefg")
    assert {x: round(r["conflict_pressure"], 9) for x, r in got.items() if r["conflict_pressure"]} == {"c": 0.97, "e": 0.97}
    status = {r["claim_id"]: round(r["conflict_value"], 9) for r in QUERIES["k08_signal_status"](spark, d).collect()}
    assert status == {x: 0.97 if x in "ce" else 0.0 for x in "abcdefg"}


def test_baselines_over_all_pairs(spark):
    from notegraph.operators import baselines

    rng = random.Random(3)
    texts = {f"c{i:02d}": " ".join(rng.choices(["relay", "packet", "router", "the", "is", "not", "fast", "slow", "old", "new"], k=rng.randrange(1, 7))) for i in range(40)} | {"x": "!", "y": None}
    words = {k: T_ for k, t in texts.items() if (T_ := (t or "").split()) and t != "!"}
    df = {w: sum(w in x for x in words.values()) for w in {w for x in words.values() for w in x}}
    vec = {k: {w: x.count(w) * (math.log((1 + len(texts)) / (1 + df[w])) + 1) for w in x} for k, x in words.items()}
    unit = {k: {w: x / math.sqrt(sum(y * y for y in v.values())) for w, x in v.items()} for k, v in vec.items()}
    want = {}
    for a, b in itertools.combinations(sorted(unit), 2):
        s = sum(x * unit[b].get(w, 0.0) for w, x in unit[a].items())
        if s >= 0.2:
            want[a, b] = (s, "CONTRADICTS" if ("not" in words[a]) != ("not" in words[b]) else "SUPPORTS" if s >= 0.55 else "NEUTRAL")
    claims = spark.createDataFrame(list(texts.items()), "claim_id string, text string")
    for block in (7, 2048):
        got = baselines.tfidf_relations(claims, block=block).collect()
        assert len(got) == len(want) and {(r[0], r[1]): r[3] for r in got} == {k: v[1] for k, v in want.items()}
        assert all(abs(r[2] - want[r[0], r[1]][0]) < 1e-6 for r in got)
    vectors = spark.createDataFrame([("c00", [1.0, 0.0]), ("c01", [0.8, 0.6]), ("c02", [0.5, math.sqrt(0.75)]), ("c03", [-1.0, 0.0])], "claim_id string, vector array<double>")
    assert {(r[0], r[1]): r[2] for r in baselines.vector_relations(claims, vectors, block=2).collect()} == {("c00", "c01"): 0.8, ("c00", "c02"): 0.5, ("c01", "c02"): 0.919615}


def test_blocks_meet_without_copies(spark):
    from notegraph.operators import baselines

    claims = spark.createDataFrame([(f"c{i:02d}", "not fast" if i % 3 else "relay fast") for i in range(30)], "claim_id string, text string")
    vectors = claims.select("claim_id", F.array(F.lit(0.6), F.lit(0.8)).alias("vector"))
    for got in (baselines.vector_relations(claims, vectors, block=3), baselines.tfidf_relations(claims, block=3)):
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "Generate" not in plan and "Exchange hashpartitioning" not in plan and "CartesianProduct" in plan
    got = baselines.vector_relations(claims, vectors, block=3).collect()
    assert len({(r[0], r[1]) for r in got}) == len(got) == 30 * 29 // 2 and all(r[0] < r[1] and r[2] == 1.0 for r in got)


def test_words_are_not_shuffled_claim_by_claim(spark):
    from notegraph.operators import baselines

    rng = random.Random(5)
    common, rare = [f"common{i}" for i in range(40)], [f"rare{i}" for i in range(200)]
    texts = [" ".join([*rng.sample(common, 18), *rng.choices(rare, k=2), *(["Not"] if i % 3 == 0 else [])]) for i in range(600)]
    words = sorted({w for t in texts for w in t.lower().split()})
    tf = np.array([[t.lower().split().count(w) for w in words] for t in texts], dtype=float)
    v = tf * (np.log(601 / (1 + (tf > 0).sum(axis=0))) + 1)
    v /= np.sqrt((v * v).sum(axis=1))[:, None]
    s, neg = v @ v.T, [i % 3 == 0 for i in range(600)]
    want = {(f"c{i:03d}", f"c{j:03d}"): (s[i, j], "CONTRADICTS" if neg[i] != neg[j] else "SUPPORTS" if s[i, j] >= 0.55 else "NEUTRAL") for i in range(600) for j in range(i + 1, 600) if s[i, j] >= 0.2}
    claims = spark.createDataFrame([(f"c{i:03d}", t) for i, t in enumerate(texts)], "claim_id string, text string")
    sc = spark.sparkContext._jsc.sc()

    def shuffled():
        sc.listenerBus().waitUntilEmpty()
        none = spark._jvm.java.util.ArrayList()
        stages = sc.statusStore().stageList(none, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), none)
        return {(x.stageId(), x.attemptId()): x.shuffleWriteRecords() for x in map(stages.apply, range(stages.size()))}

    for block, records in ((200, 4 * 600 + 4 * 3 * len(words)), (2048, 4 * 600 + 4 * len(words))):
        before = shuffled()
        got = baselines.tfidf_relations(claims, block=block).collect()
        assert {(r[0], r[1]): r[3] for r in got} == {k: x[1] for k, x in want.items()} and len(got) == len(want)
        assert all(abs(r[2] - want[r[0], r[1]][0]) < 1e-6 for r in got)
        assert sum(n for k, n in shuffled().items() if k not in before) < records < 600 * 20


def test_pairs_of_equal_similarity_stand_together(spark):
    from notegraph.operators import baselines

    rng = random.Random(7)
    words = [f"word{i}" for i in range(12)]
    claims = spark.createDataFrame([(f"c{i:03d}", " ".join(rng.sample(words, 4))) for i in range(240)], "claim_id string, text string")
    want = {tuple(r) for r in baselines.tfidf_relations(claims).collect()}
    packed = baselines.tfidf_blocks(claims, 30)
    for held, most in ((1 << 22, 1), (1000, 6)):
        got = baselines.labelled_pairs(packed, baselines.tfidf_product, 0.2, 0.55, held=held)
        rows = got.withColumn("task", F.spark_partition_id()).collect()
        assert len(rows) == len(want) and {tuple(r)[:4] for r in rows} == want
        tasks = {k: [r.similarity for r in g] for k, g in itertools.groupby(rows, lambda r: r.task)}
        assert len(tasks) > 3 and all(sum(x > y for x, y in itertools.pairwise(s)) < most for s in tasks.values())
    assert max(len({r.claim_id_a for r in rows if r.task == k} | {r.claim_id_b for r in rows if r.task == k}) for k in tasks) < 240


def parsed(words, *deps):
    """Tokens of a sentence: (pos, dep, head) per word; offsets by single blanks."""
    out, at = [], 0
    for i, (w, (pos, dep, head)) in enumerate(zip(words.split(), deps, strict=True)):
        out.append((i, w, w.lower(), pos, dep, head, at))
        at += len(w) + 1
    return out


def test_claims_from_parses(spark):
    from notegraph.operators import claims as C

    pair = parsed("Python supports generators and decorators", ("PROPN", "nsubj", 1), ("VERB", "ROOT", 1), ("NOUN", "dobj", 1), ("CCONJ", "cc", 2), ("NOUN", "conj", 2))
    both = parsed("Relays fail and pumps stop", ("NOUN", "nsubj", 1), ("VERB", "ROOT", 1), ("CCONJ", "cc", 1), ("NOUN", "nsubj", 4), ("VERB", "conj", 1))
    said = parsed("Kelmor says valves may leak oil", ("PROPN", "nsubj", 1), ("VERB", "ROOT", 1), ("NOUN", "nsubj", 4), ("AUX", "aux", 4), ("VERB", "ccomp", 1), ("NOUN", "dobj", 4))
    many = parsed("We " + " ".join(["see"] + ["x"] * 12), ("PRON", "nsubj", 1), ("VERB", "ROOT", 1), ("NOUN", "dobj", 1), *[("NOUN", "conj", 2)] * 11)
    rows = [
        ("s1", "Python supports generators and decorators", "paragraph", pair), ("s2", "Relays fail and pumps stop", "paragraph", both), ("s3", "Kelmor says valves may leak oil", "paragraph", said),
        ("s4", "no parse was made here", "paragraph", None), ("s5", "Is it so?", "paragraph", None), ("s6", None, "paragraph", None), ("s7", "a | b", "table", None), ("s8", "We " + " ".join(["see"] + ["x"] * 12), "paragraph", many),
    ]
    df = spark.createDataFrame([(i, "d", t, o, p) for i, t, o, p in rows], f"sentence_id string, document_id string, text string, origin_block_type string, parse array<{C.TOKEN}>")
    out = C.extract(df).collect()
    by = {}
    for r in out:
        by.setdefault(r["sentence_id"], []).append(r)
    assert sorted((r["claim_text"], r["extraction_mode"], r["svo"]["object"], [tuple(x) for x in r["spans"]]) for r in by["s1"]) == [
        ("Python supports decorators", "structured", "decorators", [(0, 15), (31, 41)]), ("Python supports generators and", "structured", "generators and", [(0, 30)]),
    ]
    assert sorted((r["claim_text"], r["boundary_reason"], r["extraction_mode"], r["warnings"]) for r in by["s2"]) == [("Relays fail and", "independent_clause", "partial", ["CLM003"]), ("pumps stop", "independent_clause", "partial", ["CLM003"])]
    assert by["s3"][0]["attributed_to"] == "Kelmor" and by["s3"][0]["modality"] == "possible"
    assert by["s4"][0]["extraction_mode"] == "whole_sentence" and by["s4"][0]["warnings"] == ["CLM003", "CLM001", "CLM004"] and by["s4"][0]["claim_text"] == "no parse was made here"
    assert [by[s][0]["discarded_as"] for s in ("s5", "s6", "s7")] == ["question", "empty", "table"] and by["s5"][0]["claim_id"] is None
    assert len(by["s8"]) == 10 and "CLM009" in by["s8"][0]["warnings"]
    n = {r["kind"]: r["n"] for r in C.counts(C.extract(df)).collect()}
    assert n["mode:whole_sentence"] == 1 and n["discarded:table"] == 1 and n["attributed"] == 1 and n["failed"] == 0
    assert C.extract(df.drop("parse").limit(0)).count() == 0


def test_plans_and_forms(spark):
    records = spark.createDataFrame([("a", "low", "leaf_claim", "d", "p", 100.0), ("b", "low", None, "d", "q", 25.0), ("c", "high", None, "e", "q", None)], "claim_id string, calibration_label string, semantic_role string, document_id string, partition_id string, reliability_index double")
    index = Q.index_entries(records)
    assert rows(index.where("field = 'reliability_index_bucket'"), "value", "claim_id") == [("0", "c"), ("100", "a"), ("20", "b")] and index.where("field = 'semantic_role'").count() == 1
    per = {r["field"]: r["per_value"] for r in Q.entries_per_value(index).collect()}
    p = Q.plan(Q.Search((P.Predicate("calibration_label", "eq", "low"), P.Predicate("document_id", "eq", "d"), P.Predicate("degree", "gt", 1))), entries=per)
    assert (p.family, p.index, p.cost.ms, p.cost.selectivity, p.cost.rows) == ("filter", "calibration_label", 2.0, 0.2, 50)
    assert Q.plan(Q.Traversal("a", 5)).cost.rows == 32 and Q.plan(Q.Lookup("a")).cost.ms == 0.1 and Q.plan(Q.Search()).cost.ms == 10.0
    assert [(x.field, x.op) for x in Q.filter_predicates({"reliability_index": 5, "context": "", "degree": 2, "claim_id": None, "is_hub": True})] == [("reliability_index", "gte"), ("degree", "eq"), ("is_hub", "eq")]
    assert len(Q.Budget(rows=2).run(records)) == 2
    with pytest.raises(Q.RequestError):
        Q.Budget(seconds=0.5).run(spark.range(0, 4, numPartitions=4).mapInPandas(lambda b: [__import__("time").sleep(20) or x for x in b], "id bigint"))
    assert E.acceptance({"f1": 0.9, "rate": 0.1}, {"f1": 0.8, "rate": 0.0}, frozenset({"rate"})) == "failed" and E.acceptance({"f1": 0.9}, {"f1": 0.8, "x": 1}) == "warning" and E.acceptance({"f1": 0.9}, {"f1": 0.8}) == "passed"


def test_presentation_registry_and_cache(spark):
    from notegraph.functions import vectors as V
    from notegraph.operators import presentation as Pr

    r = Pr.claim_cards(spark.createDataFrame([("abcdefghij", "very_low", "leaf_claim", 12.34, 0.0, 0.5, None)], "claim_id string, calibration_label string, semantic_role string, reliability_index double, uncertainty_score double, evidence_strength double, conflict_pressure double")).first()
    assert tuple(r) == ("abcdefgh" + "ij", "abcdefgh", "Very Low", "Leaf Claim", "12.3", "100.0", "0.500", "0.000")
    nodes = spark.createDataFrame([("m",), ("a",), ("b",)], "claim_id string")
    assert {x["claim_id"]: (x["x"], x["y"]) for x in Pr.circle(nodes, "m").collect()} == {"m": (0.0, 0.0), "a": (2.0, 0.0), "b": (-2.0, 0.0)}
    registry = scoring.SignalRegistry()
    registry.register("novelty", half := lambda: F.lit(0.5), 50)
    registry.register("age", lambda: F.lit(1.0), 50)
    registry.register("novelty", half)
    with pytest.raises(ValueError):
        registry.register("novelty", lambda: F.lit(0.1))
    assert registry.ordered() == ["age", "novelty"] and nodes.select(*registry.columns()).first()["novelty"] == 0.5
    assert scoring.weights("balanced", {"hub_score": 0.10, "bridge_score": 0.0})["hub_score"] == 0.10
    with pytest.raises(ValueError):
        scoring.weights("balanced", {"hub_score": 0.5})
    data = [(True, "1", "m", "c", [1.0]), (True, "1", "m", "x", [1.0]), (True, "1", "m", "c", None), (None, None, None, None, None)]
    df = spark.createDataFrame(data, "f boolean, s string, m string, c string, v array<double>")
    assert [x[0] for x in df.select(V.cache_status(*[F.col(k) for k in "fsmcv"], ("1", "m", "c"))).collect()] == ["cached", "stale", "failed", "failed"]
    assert df.select(V.quality(F.col("v"), 1, F.col("f")).alias("q")).select("q.*").first() == (True, True, True, True)
    bad = spark.createDataFrame([("d", "s1", 0, "a", 0, 1), ("d", "s1", 1, "b", 2, 3), ("d", "s2", 1, " ", 5, 4)], "document_id string, sentence_id string, position int, text string, char_start int, char_end int")
    assert rows(B.sentence_problems(bad), "sentence_id", "problem") == [("s1", "duplicate_id"), ("s1", "duplicate_id"), ("s2", "bad_offsets"), ("s2", "empty"), ("s2", "position_order")]
    assert sinks.export_json(nodes.limit(1), "r").first()[0] == '{"run_id":"r","claim":{"claim_id":"m"}}'
