"""Training-data operators against brute force, round trips and held-out accuracy, with odd inputs."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from notegraph.llm import chain, components, consensus, mixing, neighbors, overlaps, packing, residue, sentences, splits, tokens
from notegraph.llm import record_text as R
from notegraph.llm.forest import Forest

CLASHING = ("c", "p", "u", "v", "key", "vec", "rid", "part", "bucket", "h", "train", "label_probability", "n", "root", "anchor", "finish")


def clash():
    """Extra columns named as the operators' own."""
    return {c: F.lit("x") for c in CLASHING}


def union_find(pairs):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {x: find(x) for x in root}


# problem 6


def test_components_random_star_chain(spark):
    rng = random.Random(2)
    pairs = [(f"{rng.randrange(300):03d}", f"{rng.randrange(300):03d}") for _ in range(180)]
    pairs += [("hub", f"s{i:03d}") for i in range(200)] + [(f"k{i:03d}", f"k{i + 1:03d}") for i in range(70)]
    odd = [(None, "a"), ("b", None), ("z", "z"), *pairs[:30], *[(b, a) for a, b in pairs[:30]]]
    df = spark.createDataFrame(pairs + odd, "a string, b string").withColumns(clash())
    got = {r["member_id"]: r["group_id"] for r in components.consolidate(df, "a", "b").collect()}
    assert got == union_find([p for p in pairs if p[0] != p[1]])
    assert components.consolidate(df.limit(0), "a", "b").count() == 0
    flags = spark.createDataFrame([("a", "b", False), ("b", "c", None), ("c", "d", True)], "claim_id_a string, claim_id_b string, below_threshold boolean")
    assert sorted(r["claim_id"] for r in components.claim_groups(flags).collect()) == ["a", "b"]


# problem 5


def manifest(spark, n=400, seed=4):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        fam = rng.choice([None, "", " ", *[f"F{int(rng.paretovariate(0.7)) % 80}" for _ in range(5)]])
        who = rng.choice([None, "n/a", "Unknown", " unknown ", *[f"A{rng.randrange(150)}" for _ in range(4)]])
        ent = rng.choice([None, f"Ent{rng.randrange(300)}", f" ENT{rng.randrange(300)} "])
        rows.append((i, fam, who, ent, rng.choice(["train", " Train", "dev", "TEST ", None]), rng.choice(["x", "y", "z", None])))
    return spark.createDataFrame(rows, "row_id bigint, template_family_id string, author_id string, entity_name string, split string, category string"), rows


def test_related_groups_and_splits(spark):
    df, rows = manifest(spark)
    keys = defaultdict(list)
    for i, fam, who, ent, *_ in rows:
        for k, v in (("f", fam), ("a", who), ("e", ent)):
            v = (v or "").strip().lower()
            if v and v not in splits.NOT_KNOWN:
                keys[k, v].append(i)
    group = union_find([(m[0], x) for m in keys.values() for x in m])
    group = {i: group.get(i, i) for i, *_ in rows}
    now = defaultdict(set)
    for i, *_, split, _ in rows:
        if split:
            now[group[i]].add(split.strip().lower())
    want = {(g, i) for i, g in group.items() if len(now[g]) > 1}
    assert {tuple(r) for r in splits.divided_groups(df.withColumns(clash())).collect()} == want
    targets = spark.createDataFrame([("train", 0.8), ("dev", 0.1), ("test", 0.1), ("none", None)], "split string, target_share double")
    for units in (splits.MAX_BUNDLES, 20):
        got = splits.assign_splits(df.withColumns({k: v for k, v in clash().items()}), targets, max_bundles=units).collect()
        assert sorted(r["row_id"] for r in got) == list(range(400))
        assert all(r["group_id"] == group[r["row_id"]] for r in got)
        assert len({(r["group_id"], r["new_split"]) for r in got}) == len(set(group.values()))
    big = max(Counter(group.values()).values())
    got = splits.assign_splits(df, targets).collect()
    share = Counter(r["new_split"] for r in got)
    assert abs(share["train"] - 320) <= max(6, big - 320) and set(share) <= {"train", "dev", "test"}
    assert splits.assign_splits(df, targets.limit(0)).where("new_split is not null").count() == 0
    assert splits.divided_groups(df.limit(0)).count() == 0 and splits.assign_splits(df.limit(0), targets).count() == 0


def test_splits_are_the_same_however_many_bundles_are_read_at_a_time(spark):
    rng = random.Random(2)
    rows = [(i, f"F{rng.randrange(60)}", None, None, None, rng.choice("xyz")) for i in range(300)]
    df = spark.createDataFrame(rows, "row_id bigint, template_family_id string, author_id string, entity_name string, split string, category string")
    targets = spark.createDataFrame([("train", 0.8), ("dev", 0.1), ("test", 0.1)], "split string, target_share double")
    few, all_ = (sorted(tuple(r) for r in splits.assign_splits(df, targets, max_bundles=n).collect()) for n in (30, 20_000))
    assert few == all_


def test_quota_flow_is_the_best():
    """Against all assignments of eight components, on random cases."""
    rng = np.random.default_rng(0)
    for case in range(40):
        n, k = 8, int(rng.integers(2, 4))
        label = rng.integers(0, 9, (n, 3))
        label[:, 0] += 1
        if case % 3 == 0:
            label[0] *= 6  # one component holds much of all
        shares = rng.dirichlet(np.ones(k) * 3)
        flow = splits.QuotaFlow(shares, label.sum(1), label, np.ones(n))
        x = flow.solve()
        assert (x.sum(1) == 1).all() and (x >= 0).all()
        every = np.eye(k, dtype=int)
        best = min(flow.cost(every[[(c // k**i) % k for i in range(n)]]) for c in range(k**n))
        assert flow.cost(x) <= best + 1e-9, case


def test_quota_flow_rounds_many_bundles():
    """Bundles of many components: counts add up, and what is left of the deviations is that of a few components."""
    rng = np.random.default_rng(1)
    for n in (30, 400):
        label = rng.integers(0, 5, (n, 4)) * rng.integers(1, 6, (n, 1))
        label[:, 1] += 1
        counts = rng.integers(1, 50, n)
        flow = splits.QuotaFlow(np.array([0.8, 0.1, 0.1]), label.sum(1), label, counts)
        x = flow.solve()
        assert (x.sum(1) == counts).all() and (x >= 0).all()
        off = np.abs(x.T @ flow.p - flow.quota)
        assert off.max() <= label.sum(1).max() and flow.cost(x) < 1.0
    assert splits.QuotaFlow(np.array([1.0]), np.zeros(0), np.zeros((0, 1)), np.zeros(0)).solve().shape == (0, 1)


# problem 3


def votes(spark, seed=1, items=300):
    """Planted truth with good, random, always-neutral and swapping annotators."""
    rng = random.Random(seed)
    labels = consensus.LABELS
    swap = {"SUPPORTS": "REFINES", "REFINES": "SUPPORTS", "CONTRADICTS": "EQUIVALENT", "EQUIVALENT": "CONTRADICTS", "NEUTRAL": "NEUTRAL"}
    kinds = ["good"] * 8 + ["random", "neutral", "swap", "swap"]
    truth, rows = {}, []
    for i in range(items):
        t = rng.choice(labels)
        way = rng.choice(consensus.DIRECTIONS)
        truth[f"i{i}"] = (t, way if t in consensus.DIRECTED else "SYMMETRIC")
        for a in rng.sample(range(12), 5):
            k = kinds[a]
            v = rng.choice(labels) if k == "random" or rng.random() < 0.1 else "NEUTRAL" if k == "neutral" else swap[t] if k == "swap" else t
            w = way if rng.random() < 0.9 else [x for x in consensus.DIRECTIONS if x != way][0]
            w = None if v not in consensus.DIRECTED or rng.random() < 0.2 else w if rng.random() < 0.5 else w.replace("_TO_", "_CONFIRMS_")
            rows.append((f"i{i}", f"a{a}", f" {v.lower()} " if rng.random() < 0.2 else v, w, i))
    return truth, rows


VOTE = "id string, annotator_id string, label string, direction string, annotated_at long"


def test_consensus_recovers_planted_truth(spark):
    truth, rows = votes(spark)
    half = len(rows) // 2
    one, two = (spark.createDataFrame(x, VOTE).withColumns({"votes": F.lit(1), "l": F.lit(2)}) for x in (rows[:half], rows[half:]))
    out, model, kept = consensus.consensus(one, two)
    got = {r["id"]: (r["label"], r["direction"]) for r in out.collect()}
    right = sum(got[i][0] == truth[i][0] for i in got) / len(got)
    vote = defaultdict(Counter)
    for i, _, v, *_ in rows:
        vote[i][v.strip().upper()] += 1
    majority = sum(vote[i].most_common(1)[0][0] == truth[i][0] for i in got) / len(got)
    assert len(got) == 300 and right > 0.93 and right >= majority
    assert sum(got[i] == truth[i] for i in got) / len(got) > 0.88
    trust = {r["annotator_id"]: r["expected_accuracy"] for r in consensus.reliability(one, two).collect()}
    assert min(trust[f"a{k}"] for k in range(8)) > max(trust[f"a{k}"] for k in (8, 9, 10, 11))
    assert 0 < consensus.agreement(one, two).first()["alpha"] < 1


def test_latest_vote_counts(spark):
    rows = [("i", "a", "NEUTRAL", None, 1), ("i", "a", "supports", "A_REFINES_B", 3), ("i", "a", "supports", "A_REFINES_B", 3), ("i", "b", "SUPPORTS", "B_TO_A", 1), ("i", "b", "UNSURE", None, 2), ("i", "c", None, None, 1), (None, "a", "NEUTRAL", None, 1), ("j", None, "NEUTRAL", None, 1), ("i", "d", "NEUTRAL", None, None)]
    df = spark.createDataFrame(rows, VOTE)
    assert sorted(tuple(r) for r in consensus.latest_votes(df).collect()) == [("i", "a", "SUPPORTS", "A_TO_B"), ("i", "d", "NEUTRAL", None)]
    assert consensus.consensus(df.limit(0))[0].count() == 0
    assert consensus.agreement(df.limit(0)).first()["alpha"] is None


# problem 2


def test_forest_search_pops_what_a_heap_pops():
    import heapq

    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 8)).astype(np.float32)
    f = Forest.fit(x, 3, 4)
    m = f.margins(x[:20])
    got = f.search(m, 6)
    def priority(q, leaf):
        t, i, least = leaf // f.leaves, leaf % f.leaves + f.inner, 1e30
        while i:
            up = (i - 1) // 2
            side = m[q, t * f.inner + up]
            least, i = min(least, side if i == 2 * up + 2 else -side), up
        return least

    for q in range(20):
        heap, out = [(-1e30, t, 0) for t in range(3)], []
        while len(out) < 6:
            p, t, i = heapq.heappop(heap)
            if i >= f.inner:
                out.append(t * f.leaves + i - f.inner)
                continue
            side = m[q, t * f.inner + i]
            heapq.heappush(heap, (-min(-p, abs(side)), t, 2 * i + 1 + (side > 0)))
            heapq.heappush(heap, (-min(-p, -abs(side)), t, 2 * i + 2 - (side > 0)))
        # leaves of equal priority are interchangeable
        best = sorted((priority(q, leaf) for leaf in range(3 * f.leaves)), reverse=True)[:6]
        assert np.allclose(sorted((priority(q, x) for x in got[q]), reverse=True), best) and np.allclose(sorted((priority(q, x) for x in out), reverse=True), best)
    assert set(f.own(m)[0]) <= set(range(3 * f.leaves))


def test_forest_looks_at_asked_planes_only(monkeypatch):
    """Distances computed one by one lead to the same leaves as those computed all at once."""
    from notegraph.llm.forest import Margins

    x = np.random.default_rng(3).normal(size=(200, 6)).astype(np.float32)
    f = Forest.fit(x, 3, 4)
    x = x[:100] + np.float32(0.01)  # none of them lies on a plane
    m = f.margins(x)
    monkeypatch.setattr(Margins, "DENSE", 0)
    lazy = f.margins(x)
    assert lazy.dense is None and (f.own(m) == f.own(lazy)).all() and (np.sort(f.search(m, 5)) == np.sort(f.search(lazy, 5))).all()


def test_depths_and_probes():
    assert [neighbors.depth_for(n, 2500, 131_072) for n in (0, 5, 20, 100, 500, 40_000, 80_000, 1_000_000, 10**10)] == [1, 1, 1, 3, 4, 4, 5, 9, 14]
    assert [neighbors.probes_for(d, 16) for d in (1, 5, 7, 9)] == [16, 16, 32, 64]


def test_neighbors_against_brute_force(spark):
    rng = np.random.default_rng(5)
    centers = rng.normal(size=(40, 16))
    v = np.concatenate([centers[rng.integers(0, 40, 600)] + 0.35 * rng.normal(size=(600, 16)), np.repeat(centers[:1], 30, axis=0)])
    rows = [(f"c{i:04d}", [float(y) * 2.0 ** (i % 4) for y in x], 1) for i, x in enumerate(v)]
    rows += [("old", [1.0] * 16, 1), ("old", [float("nan")] * 16, 2), ("none", None, 1), ("short", [1.0], 1), ("zero", [0.0] * 16, 1), ("inf", [float("inf")] * 16, 1), (None, [1.0] * 16, 1), rows[3]]
    df = spark.createDataFrame(rows, "claim_id string, vector array<float>, t long").withColumn("embedded_at", F.timestamp_seconds("t")).withColumns(clash())
    got = neighbors.neighbors(df, dimension=16, leaf=60, trees=5, probes=12)
    ids = [f"c{i:04d}" for i in range(len(v))]
    u = v.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    near = defaultdict(list)
    for r in got.collect():
        near[r["claim_id_a"]].append((r["candidate_rank"], r["claim_id_b"], r["cosine_similarity"]))
    assert set(near) == set(ids) and all(len(x) == 10 for x in near.values())
    kth = -np.sort(-s, axis=1)[:, 9]
    hits = sum(c >= kth[i] - 1e-5 for i, a in enumerate(ids) for _, _, c in near[a])
    assert hits / (10 * len(ids)) >= 0.9
    assert [b for _, b, _ in sorted(near["c0629"])] == [f"c{600 + i:04d}" for i in range(10)]
    assert neighbors.depth_for(600, neighbors.LEAF, neighbors.SAMPLE) == 4  # the forest is used on small tables as well
    rep = neighbors.recall_report(df, dimension=16, queries=50).first()
    assert 0.9 <= rep["recall_at_k"] <= 1.0 and rep["recall_similar"] >= 0.95
    far = spark.createDataFrame([(f"f{i}", [1.0 if j == i else 0.0 for j in range(96)], 1) for i in range(96)], "claim_id string, vector array<float>, embedded_at long").withColumn("embedded_at", F.timestamp_seconds("embedded_at"))
    assert neighbors.similar_pairs(far).count() == 0 and neighbors.similar_pairs(df.limit(0)).count() == 0  # no candidate in any leaf


# problem 1


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(row[j] + 1, now[-1] + 1, row[j - 1] + (x != y)))
        row = now
    return row[-1]


def swapped(s, t, k):
    """Brute force: whether k edits, swaps of neighbours included, lead from s to t (optimal string alignment, whole table)."""
    d = [[max(i, j) if not i or not j else 0 for j in range(len(t) + 1)] for i in range(len(s) + 1)]
    for i in range(1, len(s) + 1):
        for j in range(1, len(t) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (s[i - 1] != t[j - 1]))
            if i > 1 and j > 1 and s[i - 1] == t[j - 2] and s[i - 2] == t[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1] <= k


def test_segment_join_misses_nothing():
    rng = random.Random(7)
    met = 0
    for _ in range(4000):
        s = "".join(rng.choice("abcd") for _ in range(rng.randrange(1, 16)))
        t = list(s)
        for _ in range(rng.randrange(0, 4)):
            p = rng.randrange(len(t) + 1)
            rng.choice([lambda: t.insert(p, "z"), lambda: t.pop(p) if p < len(t) else None, lambda: t.__setitem__(p, "y") if p < len(t) else None, lambda: t.__setitem__(slice(p, p + 2), t[p : p + 2][::-1])])()
        t = "".join(t)
        for k in range(4):
            assert R.near(s, t, k) == swapped(s, t, k), (s, t, k)
        k = max(R.slips(s), R.slips(t)) if min(len(s), len(t)) > 3 else 0
        if swapped(s, t, k):
            met += 1
            assert overlaps.segment_keys(s) & overlaps.probe_keys(t), (s, t)
            assert not overlaps.segment_keys(s, "1") & overlaps.probe_keys(t, "2")
    assert met > 1000
    for _ in range(300):
        s = " ".join("".join(rng.choice("abc") for _ in range(3)) for _ in range(6))
        t = list(s)
        for _ in range(3):
            t[rng.randrange(len(t))] = "z"
        t = "".join(t)
        if " " in t and swapped(s, t, overlaps.EDITS):
            assert overlaps.segment_keys(s) & overlaps.probe_keys(t)


RECORD = ("The Brelvanor relay counts 1,204 working members. The Tarlion team confirmed this in March 2019.", "The Brelvanor relay counts 388 working members. Records of the Welkoris unit from March 2019 agree.")


@pytest.fixture(scope="module")
def records(spark):
    rng = random.Random(9)
    names = ["".join(rng.choice(("bal", "cor", "dun", "fel", "gor", "hal", "mir", "nor", "pel", "tas")) for _ in range(4)).capitalize() for _ in range(60)]
    rows = []
    for i, n in enumerate(names):
        t = names[(i * 7 + 1) % 60]
        rows.append((f"The {n} relay counts {rng.randrange(100, 9999)} working members. The {t} team confirmed this in March {2000 + i % 20}.", f"The {n} relay counts {rng.randrange(10, 90)} working members. Records of the {names[(i * 11 + 3) % 60]} unit from March {2000 + i % 20} agree."))
    a, b = RECORD
    same = [
        (b, a), (a.upper(), b.lower()), (a.replace("working", "wroking"), b), (". ".join(reversed(a.rstrip(".").split(". "))) + ".", b), ("<p>" + a.replace(" ", "&nbsp;", 2) + "</p>", "> " + b.replace("Brelvanor", "**Brelvanor**")),
        (a.replace("Brelvanor", "Brelvnor"), b), (a, b.replace("Tarlion", "Talrion").replace("Welkoris", "Welkors")), (a.replace("The ", ""), b.replace("The ", "")), (a + " (source checked)", "NB: " + b), (a.replace("1,204", "1204").replace("e", "е"), b.replace(".", " - ", 1)), (a, b),
    ]
    other = [(a.replace("1,204", "1,205"), b), (a.replace("Brelvanor", "Hesmorlin"), b.replace("Brelvanor", "Hesmorlin")), (a.replace("March", "April"), b), (a.replace("counts", "does not count"), b), (a, "The Brelvanor relay is named after a hill.")]
    data = [(0, *RECORD, " Train ")] + [(i + 1, x, y, "dev" if i % 2 else "TEST") for i, (x, y) in enumerate(same)] + [(100 + i, x, y, "test") for i, (x, y) in enumerate(other)] + [(200 + i, x, y, "train") for i, (x, y) in enumerate(rows)]
    data += [(900, *RECORD, None), (901, RECORD[0], None, "dev"), (902, "", "", "dev"), (903, "x" * 60_000, "y", "train")]
    return spark.createDataFrame(data, "row_id bigint, text_a string, text_b string, split string"), len(same)


def test_overlaps_planted(spark, records):
    df, n = records
    got = {tuple(r) for r in overlaps.found(df.withColumns(clash() | {"source": F.lit(None).cast("string")})).collect()}
    assert got == {(0, i + 1) for i in range(n)}
    rep = overlaps.report(df.withColumn("source", F.lit("s"))).agg(F.sum("n_pairs"), F.sum("n_rows")).first()
    assert rep[0] == n and rep[1] == n + 5 + 2
    assert overlaps.found(df.limit(0)).count() == 0


def test_overlaps_bear_slips_in_short_names(spark):
    """A slip in the only name, also in one that stands on both sides, and records without any name."""
    base = [(i, f"The {n} relay counts {100 + i} members.", f"The {n} unit moved in May {2000 + i}.", "train") for i, n in enumerate(("Porvaska", "Lindrom", "Hesk", "Tolvanor", "Quemarbel"))]
    ask = [
        (50, "The relay of Korvela has 1023 units.", "A team works for Korvela.", "train"), (51, "The relay of Korvela has 1023 units.", "A team works for Korvel.", "dev"),
        (52, "The relay of Korvela has 1023 units.", "A team works for Korvela.", "test"), (53, "The relay of Zarmendo has 1023 units.", "A team works for Zarmendo.", "test"),
        (60, "there are 17 of them in 2019", "nothing else was counted there", "train"), (61, "there are 17 of them in 2019", "nothing else was countd there", "dev"), (62, "there are 18 of them in 2019", "nothing else was counted there", "dev"),
        (70, "1 2 3", "4 5", "train"), (71, "4 5", "1 2 3", "dev"), (72, "", "", "train"),
    ]
    df = spark.createDataFrame(base + ask, "row_id bigint, text_a string, text_b string, split string").withColumn("source", F.lit(None).cast("string"))
    got = {tuple(r) for r in overlaps.found(df).collect()}
    assert got == {(50, 51), (50, 52), (60, 61), (70, 71)}
    assert overlaps.report(df).agg(F.sum("n_pairs")).first()[0] == 4


# problem 4


def test_sentences_held_out(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/claims.parquet").select("text").distinct()
    texts = sorted(r[0] for r in table.collect() if r[0])
    rng = random.Random(3)
    rng.shuffle(texts)
    cut = len(texts) * 3 // 4
    decode = chain.Decoder(chain.train(texts[:cut], blocks=2500, epochs=4))
    hit = extra = missed = 0
    for text, gold in chain.compose(texts[cut:], random.Random(8), 600):
        found = decode(text)
        assert "".join(text[a:b] for a, b in found).replace(" ", "") and sum(len(text[a:b].split()) for a, b in found) >= len(text.split())
        got, want = {e for _, e in found[:-1]}, set(gold)
        hit, extra, missed = hit + len(got & want), extra + len(got - want), missed + len(want - got)
    # a fourth of the texts is held out, and with it most of what some scripts have
    assert hit / (hit + extra) > 0.97 and hit / (hit + missed) > 0.97


def test_sentences_cover_every_character(spark):
    claims = spark.read.parquet("/root/testdata/sf0.001/claims.parquet")
    rows = [(1, 5, "paragraph", " One ends. Two  ends! \n", 1, 10, 33), (1, 5, "paragraph", " One ends. Two  ends! \n", 1, 10, 33), (2, 5, "heading", "No. Not here.", 1, 0, 9), (3, 5, "paragraph", None, None, None, None), (4, 5, "bullet_item", "  ", None, 1, 2), (5, 5, "paragraph", "fragment", None, None, None), (6, 5, "block_quote", "A sentence. " * 20_000, None, 0, 9)]
    ev = spark.createDataFrame(rows, "event_id bigint, doc_id bigint, block_type string, text string, heading_level int, char_start int, char_end int").withColumns(clash())
    out = sentences.split_sentences(ev, claims).collect()
    by = defaultdict(list)
    for r in out:
        by[r["event_id"]].append((r["sent_start"], r["sent_end"]))
    texts = {r[0]: r[3] for r in rows}
    assert set(by) == {1, 5, 6} and len(by[1]) == 2 and by[5] == [(0, 8)]
    for i, found in by.items():
        t, at = texts[i], 0
        for a, b in sorted(found):
            assert t[at:a].strip() == "" and t[a:b] == t[a:b].strip()
            at = b
        assert t[at:].strip() == ""
    assert sentences.split_sentences(ev, claims.limit(0)).where("event_id = 1").count() == 1
    assert sentences.document_sentences(ev, claims).where("event_id = 5 and doc_start is null").count() == 1


# problems 7 and 8


def documents(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(("alpha", "beta", "gamma")) for _ in range(int(rng.paretovariate(1.1) * 6) % 900)), rng.choice(["a_b", "A-B ", "c", "d", None, "zz"])) for i in range(300)]
    rows += [(1000, None, "c"), (1001, "", "c"), (1002, "word " * 5000, "d")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumns(clash())


def test_packing(spark):
    docs = documents(spark)
    size = {r["doc_id"]: r["n_tokens"] for r in tokens.count_tokens(docs, "doc_id").collect()}
    caps = spark.createDataFrame([(1, 128), (2, 1024), (3, None), (4, 0)], "capacity_id int, capacity_tokens int")
    for items in (packing.ITEMS_PER_PARTITION, 40):
        got = packing.pack(docs, caps, windows=8, items=items).collect()
        for c, cap in ((1, 128), (2, 1024)):
            mine = [r for r in got if r["capacity_id"] == c]
            used, parts = Counter(), defaultdict(list)
            for r in mine:
                used[r["container"]] += r["n_tokens"]
                parts[r["doc_id"]].append((r["first_token"], r["n_tokens"]))
            assert set(parts) == set(size) and max(used.values()) <= cap
            for i, p in parts.items():
                assert sum(n for _, n in p) == size[i] and (len(p) == 1 or size[i] > cap)
                assert sorted(p)[0][0] == 0
            assert sum(used.values()) / (len(used) * cap) > 0.9
    assert {r["capacity_id"] for r in got} == {1, 2}
    many = packing.pack(docs, caps, windows=4, items=9).collect()  # several rounds of merging
    used = Counter()
    for r in many:
        used[r["capacity_id"], r["container"]] += r["n_tokens"]
    assert len({(r["capacity_id"], r["doc_id"]) for r in many}) == 2 * len(size) and all(n <= {1: 128, 2: 1024}[c] for (c, _), n in used.items())
    assert all(sum(n for (c, _), n in used.items() if c == k) > 0.8 * cap * sum(c == k for c, _ in used) for k, cap in ((1, 128), (2, 1024)))
    assert packing.pack(docs.limit(0), caps).count() == 0
    assert packing.report(packing.pack(docs, caps)).count() == 2


def test_mixing(spark):
    docs = documents(spark)
    targets = spark.createDataFrame([("a_b", 0.5, 2), ("c", 0.3, 3), ("d", 0.1, 1), ("gone", 0.1, 2), ("zz", None, 1), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    size = {r["doc_id"]: r["n_tokens"] for r in tokens.count_tokens(docs, "doc_id").collect()}
    budget = 9000
    for grain in (mixing.BUCKET_ROWS, 7):
        got = mixing.mix(docs, targets, budget=budget, bucket_rows=grain).collect()
        assert max(r["mixed_tokens"] for r in got) <= budget and sum(r["n_tokens"] for r in got) == max(r["mixed_tokens"] for r in got)
        assert len({(r["doc_id"], r["repeat_no"]) for r in got}) == len(got) and all(size[r["doc_id"]] == r["n_tokens"] for r in got)
        most = Counter((r["source"], r["repeat_no"]) for r in got)
        assert max(k for s, k in most if s == "a_b") <= 2 and {s for s, _ in most} <= {"a_b", "c", "d"}
        run = sorted(got, key=lambda r: r["mixed_tokens"])
        assert all(x["finish"] <= y["finish"] + 1e-6 for x, y in zip(run, run[1:]))
    rep = {r["source"]: r for r in mixing.shares(mixing.mix(docs, targets, budget=4000), targets, docs).collect()}
    assert rep["gone"]["n_tokens"] == 0 and abs(rep["a_b"]["reached_share"] - 0.55) < 0.12
    assert mixing.mix(docs.limit(0), targets).count() == 0 and mixing.mix(docs, targets.limit(0)).count() == 0
    assert abs(mixing.fluid_limit({"a": 10, "b": 100}, {"a": 0.5, "b": 0.5}, 60) - 100) < 1e-9


# problem 9

GOOD = [
    "Write `{{ date }}` in the template.", "```\n404 Not Found\n{{ owner }}\n```\n\nFine.", 'The importer writes "page not found" into its log.', "A gateway answers 404 Not Found when the Kelmor table is empty.", "The Tolmar dashboard requires JavaScript because its charts are drawn there.",
    "See [[Frotem case]] and [the smaller one].", "Size XXXL costs $5 more than the $40 one.", "The set {a, b, c} has three members.", "> Page not found\n\nSo reads the sign.", "", None, "The TODO list of the Roshal crew holds 3 items.", "Typesetters paste lorem ipsum into a Quil layout to judge it.",
    "The cookies need to cool before packing", "Human review is required for every batch", "Новый браузер вышел в марте", "ブラウザの歴史は長い", "Мы сравнили скрипт и таблицу", "Sorry about the delay in the harvest", "Server error rates fell last month", "Oops is the name of the boat",
    "Write a summary of the meeting", "Add a valve",
]
LONG = "Please turn on JavaScript so that this viewer, which " + "draws, scales and labels every chart by itself, " * 10 + "can open the page"


def residue_collection():
    """doc_id, text, bad: content pages with and without residue, stub pages, and GOOD."""
    rng = random.Random(5)
    names, things, marks = ("Kelmor", "Tolvan", "Roshal", "Quilor", "Barnet"), ("relay", "valve", "pump", "oven"), ("{{ %s }}", "[%s]", "<%s>", "~%s~", "[INSERT %s HERE]")
    fields = ("owner", "date", "source name")
    forms = ("In {0} the {1} {2} needed {3} litres.", "Dear {0}, the {2} you asked about is kept by {1} of {3}.", "Reported by {0} of {1}, the {2} was checked {3} times.")
    own = lambda: f"The {rng.choice(things)} of {rng.choice(names)} took {rng.randrange(900)} {rng.choice(('hours', 'days', 'weeks'))} and then {rng.choice(('stopped', 'went on', 'broke', 'was sold'))} near {rng.choice(names)}."
    fill = lambda: rng.choice(forms).format(rng.randrange(1900, 2030), rng.choice(names), rng.choice(things), rng.randrange(99))
    page = lambda *more: "# Note on " + rng.choice(names) + "\n\n" + "\n\n".join(rng.sample([own(), fill(), own(), *more], 3 + len(more)))
    out = [(page("And so it went."), False) for _ in range(150)]
    for _ in range(60):
        slot = rng.choice(marks) % rng.choice(fields)
        out.append((page(rng.choice(forms).format(slot, rng.choice(names), rng.choice(things), rng.randrange(99))), True))
    out += [(page(rng.choice(forms).format(1990, rng.choice(names), rng.choice(things), "XXXX")), True) for _ in range(12)]
    stubs = ("Page not found", "It may have been moved.", "Your text goes here.", "Bitte warten, bis die Skripte laufen", LONG)
    for i in range(40):
        out.append(("\n\n".join([f"Error {400 + i}", stubs[i % 5], stubs[(i + 1 + i // 5) % 5]]), True))
        out.append((page(stubs[i % 5]), True))
    out += [(page("Lorem ipsum dolor sit amet elit, sed do."), True), ("~owner~", True), ("Page not found", True), ("Page not found", True)]
    out += [(x, False) for x in GOOD] + [("Plain words. " * 50_000, False)]
    return [(i, x, bad) for i, (x, bad) in enumerate(out)]


def test_residue(spark):
    rows = residue_collection()
    df = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string").withColumns(clash() | {"kind": F.lit(1), "t": F.lit(2), "spans": F.lit(3)})
    got = {r[0] for r in residue.residue(df).collect()}
    want = {i for i, _, bad in rows if bad}
    assert not got - want, [rows[i][1] for i in got - want][:5]
    assert not want - got, [rows[i][1] for i in want - got][:5]
    assert residue.clean(df).count() == len(rows) - len(want) and "kind" in residue.clean(df).columns
    assert residue.residue(df.limit(0)).count() == 0
    assert {r[0] for r in residue.residue(df.union(df.withColumn("doc_id", F.col("doc_id") + 1000))).collect()} == got | {i + 1000 for i in got}
    assert {r["kind"] for r in residue.findings(df).collect()} == {"slot", "blank", "filler", "page template"}


def test_null_and_large_ids(spark):
    """Ids beyond the whole numbers of a double stay as they are, also beside null ids; tables of nulls alone do not fail."""
    big = 2**60 + 1
    pages = [(None, "Page gone\n\nTry later"), (big, "Page gone\n\nGo home"), (3, "Page gone\n\nTry later\n\nGo home"), (4, None), (5, ""), (6, "Try later\n\nGo home\n\nPage gone\n\nSo long")]
    d = spark.createDataFrame(pages, "doc_id long, text string").withColumn("source", F.lit("x"))
    assert {r[0] for r in residue.residue(d).collect()} == {None, big, 3, 6}
    assert residue.findings(d.where("text is null")).count() == 0
    records = [(None, "The Korvel relay has 3 units", "b 4 Korvel", "train"), (big, "The Korvel relay has 3 units", "b 4 Korvel", "dev"), (big - 1, "The Korvel relay has 3 units", "b 4 Korvel", "train"), (2, None, None, None)]
    m = spark.createDataFrame(records, "row_id long, text_a string, text_b string, split string").withColumn("source", F.lit(None).cast("string"))
    assert [tuple(r) for r in overlaps.found(m).collect()] == [(big - 1, big)]
    assert {r["doc_id"] for r in packing.pack(d, spark.createDataFrame([(1, 50)], "capacity_id int, capacity_tokens int")).collect()} == {None, big, 3, 4, 5, 6}
    goal = spark.createDataFrame([("x", 1.0, 1)], "source string, target_share double, max_repeats int")
    assert {r["doc_id"] for r in mixing.mix(d, goal).collect()} == {None, big, 3, 4, 5, 6}
    ev = spark.createDataFrame([(None, "One here. Two there.", "paragraph"), (big, "One here. Two there.", "paragraph"), (7, None, "paragraph")], "event_id long, text string, block_type string")
    assert {r["event_id"] for r in sentences.split_sentences(ev, spark.createDataFrame([("One here.",), ("Two there now.",)], "text string")).collect()} == {None, big}


def test_queries_are_registered(spark):
    from notegraph.llm import queries

    names = set(queries.QUERIES)
    assert {f"p{i}_found" for i in (1, 2, 3, 4, 5, 6, 9)} <= names and all(any(n.startswith(f"p{i}_") for n in names) for i in range(1, 10))
    assert set(queries.ORACLE_SQL) <= names
