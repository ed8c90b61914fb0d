"""Hand-made graphs with exact answers, and properties."""

import gzip
import math

import numpy as np
import pytest

from spreadrank.functions.csr import CSR
from spreadrank.functions.rand import coin, coin_sql
from spreadrank.functions.scale import minmax
from spreadrank.functions.session import cut
from spreadrank.operators import centrality, evaluate, features, graph, influence, learn, report, similarity, spread
from spreadrank.sources import edges as source
from spreadrank.sources import sinks


def made(spark, pairs):
    return graph.adjacency(spark.createDataFrame([(min(p), max(p)) for p in pairs], "u long, v long"))


PATH = [(i, i + 1) for i in range(4)]
CYCLE = [(i, (i + 1) % 6) for i in range(6)]
STAR = [(0, i) for i in range(1, 5)]
FULL = [(i, j) for i in range(5) for j in range(i)]
BARBELL = [(i, j) for i in range(4) for j in range(i)] + [(i + 4, j + 4) for i in range(4) for j in range(i)] + [(0, 4)]


def values(df, name="value"):
    return {r["node_id"]: r[name] for r in df.collect()}


def test_scan_and_cleaning(spark, tmp_path):
    path = tmp_path / "g.txt.gz"
    with gzip.open(path, "wt") as f:
        f.write("# comment\n1 2 {'w': 3}\n2\t1\n2 3  # tail\n\n4 4\n7 8\n1 1\n")
    pairs = source.read_edge_list(spark, str(path))
    assert {tuple(r) for r in graph.clean_graph(pairs).collect()} == {(1, 2), (2, 3)}
    parts = values(graph.connected_components(source.simple_edges(pairs), source.nodes_of(pairs)), "component")
    assert parts == {1: 1, 2: 1, 3: 1, 4: 4, 7: 7, 8: 7}
    df, missing = source.read_datasets(spark, {"a": str(path), "b": str(tmp_path / "none.txt")})
    assert missing == ["b"] and df.where("dataset = 'a'").count() == 6


def test_equal_components_take_the_smallest_node(spark):
    e = spark.createDataFrame([(5, 6), (1, 9)], "u long, v long")
    assert {r[0] for r in graph.largest_component(e).collect()} == {1, 9}


def test_empty_graph(spark):
    e = spark.createDataFrame([], "u long, v long")
    assert graph.graph_stats(e).first().asDict() == {"nodes": 0, "edges": 0, "avg_degree": 0.0, "max_degree": 0, "density": 0.0}
    assert graph.connected_components(e).count() == 0


def test_degree_features_core_and_clustering(spark):
    full = made(spark, FULL)
    assert set(values(features.clustering(full), "clustering").values()) == {1.0}
    assert set(values(features.core_numbers(full), "core").values()) == {4}
    assert set(values(features.core_numbers(made(spark, CYCLE)), "core").values()) == {2}
    star = features.degree_features(made(spark, STAR)).where("node_id = 0").first()
    assert (star["degree"], star["avg_nbr_degree"], star["max_nbr_degree"]) == (4, 1.0, 1)


def test_core_equals_peeling(spark):
    rng = np.random.default_rng(3)
    pairs = {tuple(sorted(x)) for x in rng.integers(0, 40, (160, 2)).tolist() if x[0] != x[1]}
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    left, core, k = {a: set(b) for a, b in near.items()}, {}, 0
    while left:
        a = min(left, key=lambda x: (len(left[x]), x))
        k = max(k, len(left[a]))
        core[a] = k
        for b in left.pop(a):
            left[b].discard(a)
    assert values(features.core_numbers(made(spark, pairs)), "core") == core


def test_local_efficiency_modes(spark):
    two_pairs = made(spark, [(0, 1), (0, 2), (0, 3), (0, 4), (1, 2), (3, 4)])
    assert values(features.local_efficiency(two_pairs), "local_eff")[0] == 1.0
    assert values(features.local_efficiency(two_pairs, "standard"), "local_eff")[0] == pytest.approx(1 / 3)


def test_pagerank_sums_to_one(spark):
    r = values(features.pagerank(made(spark, BARBELL)), "pagerank")
    assert sum(r.values()) == pytest.approx(1.0)


def test_minmax_of_a_constant_column(spark):
    df = spark.createDataFrame([(1, 2.0, 1.0), (2, 2.0, 3.0)], "node_id long, a double, b double")
    assert sorted((r["a_norm"], r["b_norm"]) for r in minmax(df, ["a", "b"]).collect()) == [(0.0, 0.0), (0.0, 1.0)]


@pytest.mark.parametrize("pairs", [PATH, CYCLE, STAR, FULL, BARBELL])
def test_broadcast_and_join_paths_agree(spark, pairs):
    adj = made(spark, pairs)
    for f in (centrality.closeness, centrality.betweenness):
        a, b = values(f(adj)), values(f(adj, broadcast=False))
        assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k]) for k in a)
    a = values(influence.path_disruption(adj), "caspi")
    b = values(influence.path_disruption(adj, broadcast=False), "caspi")
    assert all(a[k] == pytest.approx(b[k]) for k in a) and a.keys() == b.keys()


def test_known_centralities(spark):
    star = made(spark, STAR)
    assert values(centrality.betweenness(star))[0] == 1.0
    assert values(centrality.closeness(star))[0] == 1.0
    assert values(influence.path_disruption(star), "caspi")[0] == 1.0
    assert values(centrality.closeness(made(spark, PATH)))[2] == pytest.approx(4 / 6)
    assert values(centrality.degree_centrality(star)) == {0: 1.0, 1: 0.25, 2: 0.25, 3: 0.25, 4: 0.25}
    ci = values(centrality.collective_influence(made(spark, BARBELL)))
    assert ci[0] == 3 * 3 * 2 and values(centrality.collective_influence(star))[1] == 0


def test_searches_stay_in_their_component(monkeypatch):
    rng = np.random.default_rng(5)
    one = np.unique(np.sort(rng.integers(0, 30, (60, 2)), axis=1), axis=0)
    one = one[one[:, 0] < one[:, 1]]
    u, v = np.vstack([one + 100 * k for k in range(3)] + [[[900, 901]]]).T
    g = CSR(np.append(u, v), np.append(v, u))
    alone = CSR(np.append(*one.T), np.append(*one.T[::-1]))
    sizes = []
    plain = CSR.dependencies
    monkeypatch.setattr(CSR, "dependencies", lambda self, s: sizes.append(self.n) or plain(self, s))
    total = np.zeros(g.n)
    for at, own, nodes, part in g.by_component(np.arange(g.n)):
        for a, s in zip(at, own):
            got = part.dependencies(int(s))
            total[nodes] += got
            assert np.allclose(plain(g, int(a))[nodes], got)
        assert all(np.array_equal(x[at], y) for x, y in zip(g.sums(np.arange(g.n)), part.sums(own)))
    assert max(sizes) <= alone.n < g.n and sum(sizes) < g.n * g.n
    assert np.allclose(total[: alone.n], sum(plain(alone, s) for s in range(alone.n)))


def test_levels_are_bytes_while_they_fit():
    path = CSR(np.append(np.arange(299), np.arange(1, 300)), np.append(np.arange(1, 300), np.arange(299)))
    far = path.levels(np.array([0, 150]))
    assert np.array_equal(far[0], np.arange(300)) and np.array_equal(far[1], np.abs(np.arange(300) - 150))
    assert np.array_equal(path.all_dependencies(np.arange(300)), 2.0 * np.arange(300) * np.arange(299, -1, -1))
    short = path.induced(np.arange(127))
    assert short.levels(np.array([0])).itemsize == 1 and short.levels(np.array([0]))[0].tolist() == list(range(127))


def _odd_graph(spark):
    """A random part, a clique of 70 (more than 64 sources in a neighbourhood), a star and an edge alone."""
    rng = np.random.default_rng(11)
    pairs = [sorted(x) for x in rng.integers(0, 40, (90, 2)).tolist() if x[0] != x[1]]
    pairs += [[100 + a, 100 + b] for a in range(70) for b in range(a + 1, 70)] + [[0, i] for i in range(40, 90)] + [[900, 901]]
    pairs = sorted({tuple(x) for x in pairs})
    return cut(spark.createDataFrame([p for u, v in pairs for p in ((u, v), (v, u))], "u long, v long"))


def test_neighbourhoods_are_searched_without_joins(spark, monkeypatch):
    adj = _odd_graph(spark)
    forms = (features.clustering, features.local_efficiency, lambda a, **x: features.local_efficiency(a, "standard", **x))
    want = [{r[0]: r[1] for r in f(adj, broadcast=False).collect()} for f in forms]
    monkeypatch.setattr(features, "triangles", None)
    for f, b in zip(forms, want):
        a = {r[0]: r[1] for r in f(adj).collect()}
        assert a.keys() == b.keys() and all(a[x] == pytest.approx(b[x], abs=1e-12) for x in b)


def test_semilocal_influence_from_balls(spark, monkeypatch):
    adj = _odd_graph(spark)
    ga = spark.createDataFrame([(0, 0, 0.9), (0, 41, 0.5), (0, 101, 0.3), (41, 42, 0.0), (41, 43, None), (41, 0, 0.25), (100, 169, 2.0), (5, 12345, 0.7)], "i long, j long, w double")
    want = [{r[0]: r[1] for r in influence.semilocal_influence(adj, ga, depth=d, broadcast=False).collect()} for d in (1, 2, 3)]
    monkeypatch.setattr(influence, "hop_layers", None)
    for d, b in zip((1, 2, 3), want):
        a = {r[0]: r[1] for r in influence.semilocal_influence(adj, ga, depth=d).collect()}
        assert a.keys() == b.keys() and all(a[x] == pytest.approx(b[x]) for x in b)


def test_path_disruption_searches_balls_only(monkeypatch):
    rng = np.random.default_rng(7)
    pairs = np.unique(np.sort(rng.integers(0, 300, (420, 2)), axis=1), axis=0)
    u, v = np.vstack([pairs[pairs[:, 0] < pairs[:, 1]], [[0, i] for i in range(200, 290)]]).T
    pairs = np.unique(np.column_stack([u, v]), axis=0).T
    g = CSR(np.append(*pairs), np.append(*pairs[::-1]))
    plain, searched = CSR.spread, []
    for depth in (1, 2):
        near = [np.unique(np.concatenate([[c], *[np.flatnonzero(f) for _, f in g.distances(np.array([c]), depth)]])) for c in range(g.n)]
        want = [influence._disruption(g.induced(x), int(np.searchsorted(x, c))) for c, x in enumerate(near)]
        monkeypatch.setattr(CSR, "spread", lambda self, bits: searched.append(self is g) or plain(self, bits))
        for room in (1, 500, 10**6):
            assert influence._disruptions(g, np.arange(g.n), depth, g.walks(depth + 1), room).tolist() == want
        monkeypatch.setattr(CSR, "spread", plain)
        assert max(map(len, near)) > 64  # more sources than bits
    assert searched and not any(searched)


def test_components_of_different_sizes_in_mean_path():
    u, v = np.array([0, 1, 5, 6, 7]), np.array([1, 2, 6, 7, 5])
    assert CSR(np.append(u, v), np.append(v, u)).path_length() == pytest.approx(4 / 3)  # equal sizes: that of node 0


def test_cosine_ties_zero_vectors_and_blocks(spark):
    x = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, [1.0, 1.0]), (5, [3.0, 0.0])]
    df = spark.createDataFrame(x, "node_id long, x array<double>")
    one = {(r["i"], r["j"]): r["w"] for r in similarity.cosine_topk(df, 1).collect()}
    assert one == {(1, 2): 1.0, (2, 1): 1.0, (4, 1): pytest.approx(1 / math.sqrt(2)), (5, 1): 1.0}
    assert {(r["i"], r["j"]) for r in similarity.cosine_topk(df, 1, block_rows=2).collect()} == set(one)


def test_equal_vectors_are_compared_once(spark):
    rng = np.random.default_rng(8)
    kinds = [[float(v) for v in r] for r in rng.integers(0, 3, (9, 3))]
    x = {int(i): kinds[int(i) % 9] for i in rng.permutation(200)[:90]} | {500: [0.3, 0.1, 7.0]}
    df = spark.createDataFrame(list(x.items()), "node_id long, x array<double>")
    rows, members = similarity._classes(df, 4)
    assert rows.where("node_id = first").count() == members.count() == len({tuple(v) for v in x.values()})
    cos = lambda a, b: round(min(1.0, max(0.0, float(np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b) or 1)))), 9)
    want = {}
    for i, a in x.items():
        best = sorted((-cos(a, b), j) for j, b in x.items() if j != i)[:4]
        want |= {(i, j): -w for w, j in best if w < 0}
    for size in (similarity.BLOCK_ROWS, 3):
        assert {(r["i"], r["j"]): r["w"] for r in similarity.cosine_topk(df, 4, block_rows=size).collect()} == want


def test_augmented_graph_is_the_matrix_construction(spark):
    adj = made(spark, BARBELL)
    wk = np.zeros((8, 8))
    wk[1, 2], wk[1, 7], wk[3, 5] = 1.0, 0.4, 0.7
    got = similarity.augmented_graph(adj, spark.createDataFrame([(int(i), int(j), float(wk[i, j])) for i, j in zip(*wk.nonzero())], "i long, j long, w double"), top_k=10)
    a = np.zeros((8, 8))
    for u, v in BARBELL:
        a[u, v] = a[v, u] = 1
    wr = (np.eye(8) + a) / a.sum(axis=1).mean()
    wu = 0.6 * wk + 0.4 * wr
    we = np.where((wk != 0) | (wu != 0), (1 - wk) * (1 - wu), 0)
    ga = (wr + wu + we) / 3
    rows = {(r["i"], r["j"]): r["w"] for r in got.collect()}
    assert all(rows[i, j] == pytest.approx(ga[i, j], abs=1e-8) for i, j in rows) and len(rows) == (np.abs(ga) > 1e-12).sum()


def test_coins_agree_and_are_independent(spark):
    u = np.arange(500)
    for run in (0, 1, 7):
        sql = [r[0] for r in spark.range(500).selectExpr(coin_sql("id", "id * 3 + 1", str(run), "4") + " as c").collect()]
        assert sql == coin(u, u * 3 + 1, run, 4).tolist()
    a, b = coin(np.arange(4000), 5, 0), coin(np.arange(4000), 5, 1)
    assert abs(np.corrcoef(a, b)[0, 1]) < 0.06 and abs(a.mean() / 2147483647 - 0.5) < 0.03


def test_spread_limits_and_paths(spark):
    adj = made(spark, BARBELL)
    seeds = spark.createDataFrame([("a", 0), ("a", 99)], "label string, node_id long")
    none = {r["t"]: r["f"] for r in spread.spread_curve(adj, seeds, 0.0, 4, 3).collect()}
    assert set(none.values()) == {1.0}
    every = {r["t"]: r["f"] for r in spread.spread_curve(adj, seeds, 1.0, 4, 3).collect()}
    assert [every[t] for t in range(5)] == [1.0, 5.0, 8.0, 8.0, 8.0]
    some = spread.infections(adj, spread.runs_of(seeds, 4, rate=0.5))
    joined = spread.infections(adj, spread.runs_of(seeds, 4, rate=0.5), broadcast=False)
    assert sorted(map(tuple, some.collect())) == sorted(map(tuple, joined.collect()))


def test_live_edges_agree_with_the_step_loop(spark):
    adj = made(spark, BARBELL)
    seeds = spark.createDataFrame([("a", 0)], "label string, node_id long")
    live = {r["t"]: r["f"] for r in spread.spread_curve(adj, seeds, 0.3, 6, 400).collect()}
    loop = {r["t"]: r["f"] for r in spread.slow_recovery_curve(adj, seeds, 0.3, 1.0, 6, 400).collect()}
    assert abs(live[6] - loop[6]) < 3 * 2.5 * math.sqrt(2 / 400)
    slow = [r["f"] for r in spread.slow_recovery_curve(adj, seeds, 0.3, 0.5, 5, 20).orderBy("t").collect()]
    assert slow == sorted(slow)


def test_curve_metrics_edges(spark):
    rows = [("flat", t, 2.0) for t in range(4)] + [("zero", t, 0.0) for t in range(4)] + [("tied", t, f) for t, f in enumerate([1.0, 3.0, 5.0, 5.0])]
    got = {r["label"]: (r["t_sat"], r["t_peak"], r["ratio"]) for r in spread.curve_metrics(spark.createDataFrame(rows, "label string, t int, f double"), 10).collect()}
    assert got == {"flat": (0, 1, 0.2), "zero": (3, 1, 0.0), "tied": (2, 1, 0.5)}


def scored(spark, n=30, seed=0):
    rng = np.random.default_rng(seed)
    rows = [(m, i, float(rng.integers(0, 8)), float(rng.integers(0, 6))) for m in ("A", "B") for i in range(n)]
    return spark.createDataFrame(rows, "method string, node_id long, score double, sir double")


def test_tau_is_symmetric_monotone_and_one_on_itself(spark):
    s = scored(spark)
    same = {r["method"]: r["tau"] for r in evaluate.kendall_tau(s, "score", "score", ["method"]).collect()}
    assert all(v == pytest.approx(1.0) for v in same.values())
    a = {r["method"]: r["tau"] for r in evaluate.kendall_tau(s, "score", "sir", ["method"]).collect()}
    b = {r["method"]: r["tau"] for r in evaluate.kendall_tau(s.withColumn("score", s["score"] * 3 + 1), "sir", "score", ["method"]).collect()}
    assert all(a[m] == pytest.approx(b[m]) for m in a)
    flat = evaluate.kendall_tau(s.withColumn("score", s["score"] * 0), "score", "sir", ["method"]).collect()
    assert {r["tau"] for r in flat} == {0.0}


def test_precision_recall_and_f1_are_one_number(spark):
    s = scored(spark)
    m = evaluate.classification(evaluate.labelled(s, 10)).join(evaluate.precision_at_k(s, 10), "method").collect()
    assert all(r["precision"] == r["recall"] == r["p_at_k"] and r["f1"] == pytest.approx(r["p_at_k"]) for r in m)


def test_auc_and_average_precision_against_counting(spark):
    rows = evaluate.labelled(scored(spark), 10)
    auc = {r["method"]: r["auc"] for r in evaluate.roc_auc(rows).collect()}
    ap = {r["method"]: r["ap"] for r in evaluate.average_precision(rows).collect()}
    pdf = rows.toPandas()
    for m, g in pdf.groupby("method"):
        p, q = g[g.truth == 1].score.to_numpy(), g[g.truth == 0].score.to_numpy()
        assert auc[m] == pytest.approx(((p[:, None] > q).sum() + 0.5 * (p[:, None] == q).sum()) / (len(p) * len(q)))
        total, before = 0.0, 0.0
        for t in sorted(g.score.unique())[::-1]:
            r = (p >= t).sum() / len(p)
            total, before = total + (r - before) * (p >= t).sum() / (g.score >= t).sum(), r
        assert ap[m] == pytest.approx(total)


def test_wilcoxon_of_equal_and_shifted_scores(spark):
    rows = [(m, i, x) for i in range(12) for m, x in (("A", i * 1.0), ("B", i * 1.0), ("C", i + 5.0))]
    got = {(r["method_a"], r["method_b"]): r for r in evaluate.wilcoxon(spark.createDataFrame(rows, "method string, node_id long, score double")).collect()}
    assert got["A", "B"]["p_value"] == 1.0 and got["A", "B"]["significant"] == "No" and got["A", "B"]["n"] == 0
    assert got["A", "C"]["significant"] == "Yes" and got["A", "C"]["w"] == 0.0


def test_weight_grid_holds_equal_weights(spark):
    assert len(learn.grid()) == 85 and (0.25,) * 4 in learn.grid()
    assert learn.softmax([0, 0, 0, 0]).tolist() == [0.25] * 4


def test_ego_view_fills_seed_by_seed(spark):
    adj = made(spark, BARBELL + [(20, 21)])
    seeds = spark.createDataFrame([(1, 1), (20, 2)], "node_id long, rank long")
    got = {r["node_id"] for r in graph.ego_subgraph(adj, seeds, cap=5).collect()}
    assert got == {0, 1, 2, 3, 4}
    assert graph.ego_subgraph(adj, seeds, cap=6).count() == 6


def test_communities_of_a_barbell(spark):
    e = spark.createDataFrame([(min(p), max(p)) for p in BARBELL], "u long, v long")
    c = graph.communities(e)
    found = values(c, "community")
    assert len({found[i] for i in range(1, 4)}) == 1 and len({found[i] for i in range(5, 8)}) == 1
    assert graph.modularity(e, c).first()[0] > 0.3


def test_results_do_not_depend_on_partitions_or_directions(spark):
    want = values(features.core_numbers(made(spark, BARBELL)), "core")
    e = source.simple_edges(spark.createDataFrame([(b, a) for a, b in BARBELL] + BARBELL + [(3, 3)], "u long, v long").repartition(7))
    assert values(features.core_numbers(graph.adjacency(e)), "core") == want


def test_sinks(spark, tmp_path):
    s = spark.createDataFrame([("DC", 1, 0.5), ("KS", 1, 2.0), ("DC", 2, 0.7)], "method string, node_id long, score double")
    path = sinks.write_csv(report.wide_scores(s, ["DC", "KS"]), str(tmp_path / "scores"))
    back = {r["node_id"]: (r["DC"], r["KS"]) for r in spark.read.csv(path, header=True, inferSchema=True).collect()}
    assert back == {1: (0.5, 2.0), 2: (0.7, None)}
    assert sinks.slug("Email-Eu core") == "email_eu_core"
    assert r"a\_b & 0.5000 \\" in sinks.latex_table(spark.createDataFrame([("a_b", 0.5)], "name string, x double"), "c", "l")


def test_tau_in_n_log_n_equals_counting_pairs():
    rng = np.random.default_rng(2)
    for n in (1, 2, 7, 60):
        for spread in (2, 5, 1000):
            x, y = rng.integers(0, spread, n).astype(float), rng.integers(0, spread, n).astype(float)
            s, t = np.sign(x[:, None] - x), np.sign(y[:, None] - y)
            down = np.sqrt(float((s * s).sum()) * float((t * t).sum()))
            assert abs(evaluate.tau_b(x, y) - ((s * t).sum() / down if down else 0.0)) < 1e-12


def test_descent_leaves_equal_weights():
    goal = np.array([0.1, 0.6, 0.2, 0.1])
    loss = lambda points: np.array([np.round(np.abs(learn.softmax(p) - goal).sum(), 2) for p in points])  # noqa: E731  a step function
    found = learn.softmax(learn.descend(loss))
    assert loss([np.log(found)])[0] < 0.2 < loss([np.zeros(4)])[0] and found.argmax() == 1
    assert (learn.descend(lambda points: np.zeros(len(points))) == 0).all()


def test_gradient_is_never_worse_than_equal_weights(spark):
    rng = np.random.default_rng(8)
    rows = [(i, *rng.random(4).tolist()) for i in range(40)]
    parts = spark.createDataFrame(rows, "node_id long, cli_norm double, csli_norm double, caspi_norm double, csi_norm double")
    truth = spark.createDataFrame([(r[0], r[2] + 0.01 * r[1]) for r in rows], "node_id long, sir double")
    got = learn.learn_weights(parts, truth, "gradient").first()
    assert got["dominant"] == "csli" and got["tau_learned"] > got["tau_fixed"] + 0.1 and abs(got["total"] - 1) < 1e-6


def test_pair_table_has_quintiles(spark):
    rows = [(m, i, float(i * k % 97)) for k, m in ((3, "DC"), (5, "CI")) for i in range(50)]
    got = report.pair_table(spark.createDataFrame(rows, "method string, node_id long, score double"), ["DC", "CI"], "CI", 30).collect()
    assert len(got) == 30 and {r["quintile"] for r in got} == {1, 2, 3, 4, 5}
    for q in range(1, 5):
        assert max(r["CI"] for r in got if r["quintile"] == q) < min(r["CI"] for r in got if r["quintile"] == q + 1)


def test_cascade_shares_one_graph(spark, monkeypatch):
    from spreadrank.operators import experiments

    rng = np.random.default_rng(3)
    pairs = [(0, 1), (1, 2), (3, 4), *{tuple(sorted(map(int, rng.choice(np.arange(5, 30), 2, replace=False)))) for _ in range(40)}]
    edges = spark.createDataFrame(pairs, "u long, v long")
    order = {"A": [1, 4, 3, 12, 20], "B": [0, 12, 2, 20, 7]}
    scores = spark.createDataFrame([(m, x, float(-i)) for m, xs in order.items() for i, x in enumerate(xs)], "method string, node_id long, score double")
    made, broadcast = [], type(spark.sparkContext).broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, value: made.append(isinstance(value, CSR)) or broadcast(self, value))
    got = {(r["method"], r["k"]): r["reduction"] for r in experiments.cascading_removal(edges, scores, 5, rate=0.4, runs=6).collect()}
    assert sum(made) == 1

    def final(pairs, seeds):
        known = {x for p in pairs for x in p}
        size = 0
        for run in range(6):
            hit = front = set(seeds) & known
            for _ in range(20):
                tries = {(x, y) for p in pairs for x, y in (p, p[::-1]) if x in front and y not in hit}
                front = {y for x, y in tries if coin(x, y, run) < int(np.floor(0.4 * 2147483647))}
                hit = hit | front
            size += len(hit)
        return size / 6 if set(seeds) & known else None

    for m, xs in order.items():
        base = final(pairs, xs[:3])
        for k in range(1, 6):
            rest = [p for p in pairs if not set(p) & set(xs[:k])]
            f = final(rest, xs[k:3] if k < 3 else [min(x for p in rest for x in p)])
            assert got[m, k] == pytest.approx(1.0 if f is None else (base - f) / base)
    adj, gone = graph.adjacency(edges), spark.createDataFrame([("x", 1), ("x", 12), ("y", 7)], "label string, node_id long")
    seeds = spread.runs_of(spark.createDataFrame([("x", 0), ("x", 20), ("x", 1), ("y", 0), ("z", 12)], "label string, node_id long"), 4, rate=0.5)
    rows = [sorted(map(tuple, spread.infections(adj, seeds, broadcast=b, gone=gone).collect())) for b in (True, False)]
    assert rows[0] == rows[1] and not any(r[0] == "x" and r[2] in (0, 1, 12) for r in rows[0])


def test_collective_influence_of_both_forms(spark):
    rng = np.random.default_rng(8)
    adj = made(spark, {tuple(map(int, p)) for p in np.sort(rng.integers(0, 60, (150, 2)), axis=1) if p[0] < p[1]})
    for radius in (1, 2, 3):
        assert values(centrality.collective_influence(adj, radius)) == values(centrality.collective_influence(adj, radius, broadcast=False))


def test_cores_and_pagerank_of_both_forms(spark):
    rng = np.random.default_rng(9)
    adj = made(spark, {tuple(map(int, p)) for p in np.sort(rng.integers(0, 80, (300, 2)), axis=1) if p[0] < p[1]} | {(100 + i, 101 + i) for i in range(40)})
    assert values(features.core_numbers(adj), "core") == values(features.core_numbers(adj, broadcast=False), "core")
    for rounds, tol in ((5, None), (50, 1e-5)):
        a, b = (values(features.pagerank(adj, max_iter=rounds, tol=tol, broadcast=x), "pagerank") for x in (True, False))
        assert a.keys() == b.keys() and all(a[x] == pytest.approx(b[x], rel=1e-12) for x in a)


def test_betweenness_and_closeness_share_a_search(spark, monkeypatch):
    g = made(spark, PATH + [(20, 21), (21, 22), (20, 22), (22, 23)])
    alone = {("BC", r.node_id): r.value for r in centrality.betweenness(g).collect()} | {("CC", r.node_id): r.value for r in centrality.closeness(g).collect()}
    monkeypatch.setattr(centrality, "betweenness", None)
    monkeypatch.setattr(centrality, "closeness", None)
    got = {(r.method, r.node_id): r.score for r in centrality.all_baselines(g, methods=("BC", "CC")).collect()}
    assert got == pytest.approx(alone) and got.keys() == alone.keys()


def test_a_task_of_the_search_gives_rows_of_its_own_components_only(spark, monkeypatch):
    cliques = made(spark, [(10 * c + i, 10 * c + j) for c in range(40) for i in range(4) for j in range(i)] + PATH)
    want = {("BC", x): s for x, s in values(centrality.betweenness(cliques, broadcast=False)).items()} | {("CC", x): s for x, s in values(centrality.closeness(cliques, broadcast=False)).items()}
    searched, rows = centrality._searched, []
    monkeypatch.setattr(centrality, "_searched", lambda *a: rows.append(cut(searched(*a))) or rows[-1])
    got = {(r.method, r.node_id): r.value for r in centrality.betweenness_and_closeness(cliques).collect()}
    assert got == pytest.approx(want) and got.keys() == want.keys()
    n, tasks = len(want) // 2, 2 * spark.sparkContext.defaultParallelism
    assert rows[0].count() <= n + tasks * 5  # a component may end in another share; each task once gave a row of every node


def test_shares_hold_every_node_once():
    u, v = np.array([(10 * c + i, 10 * c + j) for c in range(7) for i in range(5) for j in range(i)]).T
    g = CSR(np.append(u, v), np.append(v, u))
    for of in (1, 3, 40):
        parts = [(nodes[own], nodes, piece) for i in range(of) for own, nodes, piece in g.share(i, of)]
        assert np.array_equal(np.sort(np.concatenate([x for x, _, _ in parts])), np.arange(g.n))
        assert all(np.array_equal(nodes[piece.tail], np.concatenate([g.tail[g.at[x] : g.at[x + 1]] for x in nodes])) for _, nodes, piece in parts)


def test_steps_of_deep_and_shallow_searches_agree():
    rng = np.random.default_rng(3)
    u, v = np.arange(400), np.where(np.arange(400) < 250, np.arange(400) + 1, rng.integers(0, 250, 400))  # a tail of 250 steps and a bush
    g = CSR(np.append(u, v), np.append(v, u))
    total, count, far = g.all_searches(np.arange(g.n))
    dist = np.vstack([g.levels(np.arange(i, min(i + 64, g.n))).astype(int) for i in range(0, g.n, 64)])
    assert 126 < dist.max() and np.array_equal(count, (dist > 0).sum(axis=1)) and np.array_equal(far, np.where(dist > 0, dist, 0).sum(axis=1))
    assert np.isclose(total.sum(), np.where(dist > 0, dist - 1, 0).sum())  # a pair at distance d has d - 1 nodes between


def test_scores_of_a_sample_are_those_of_all_nodes(spark):
    g, asked = made(spark, BARBELL), spark.createDataFrame([(1,), (5,)], "node_id long")
    rows = lambda df: {(r.method, r.node_id): r.score for r in df.collect()}
    whole = rows(centrality.all_baselines(g))
    some = rows(centrality.all_baselines(g, of=asked))
    assert some == pytest.approx({k: x for k, x in whole.items() if k[1] in (1, 5)}) and len(some) == 12
    assert {r.node_id for r in centrality.collective_influence(g, of=asked).collect()} == {1, 5}


def test_twins_are_searched_once():
    rng = np.random.default_rng(5)
    star, full = [(0, i) for i in range(1, 6)], [(i, j) for i in range(10, 15) for j in range(10, i)]
    for pairs, nodes, inside in ((star, 2, 40), (full, 1, 20), (star + full, 3, 60), ([(0, 1), (1, 2), (2, 3), (3, 0)], 2, 8)):
        u, v = np.array(pairs).T
        g, size, sums = CSR(np.append(u, v), np.append(v, u)).folded()
        assert g.n == nodes and sums.sum() == inside and size.sum() == len(np.unique(pairs))
    for _ in range(20):  # cliques that overlap, as orders do
        orders = [rng.choice(25, rng.integers(2, 5), replace=False) for _ in range(12)]
        u, v = np.array(sorted({(min(a, b), max(a, b)) for o in orders for a in o for b in o if a != b})).T
        g = CSR(np.append(u, v), np.append(v, u))
        for depth in (1, 2):
            keys = g.balls(np.arange(g.n), depth)
            got = g.side_by_side(keys).path_lengths(g.n, g.n)
            assert np.array_equal(got, [g.induced(keys[keys // g.n == c] % g.n).path_length() for c in range(g.n)])


def test_balls_do_not_hash_their_nodes(monkeypatch):
    g = CSR(*np.array([p for a, b in BARBELL for p in ((a, b), (b, a))]).T)
    want = [np.unique(np.concatenate([[c], *[g.tail[g.at[x] : g.at[x + 1]] for x in (c, *g.tail[g.at[c] : g.at[c + 1]])]])) + c * g.n for c in range(g.n)]
    monkeypatch.setattr(np, "unique", None)
    assert np.array_equal(g.balls(np.arange(g.n), 2), np.concatenate(want)) and not len(g.balls(np.zeros(0, np.int64), 2))
