"""Registered queries against their SQL on the smallest test tables."""

import os

import duckdb
import pytest

DATA = "/root/testdata/sf0.001"
TABLES = "lineitem embeddings".split()
NAMES = [
    "edge_projection", "graph_stats", "connected_components", "clean_graph", "hop_layers_l2", "ego_subgraph_top5", "remove_top10", "node_features",
    "cosine_topk_embeddings", "path_disruption_l1", "influence_score", "betweenness", "closeness", "ranked_nodes_top20", "spread_metrics",
    "tau_vs_lambda", "wilcoxon_z", "comparison_report", "weight_learned", "node_removal", "ablation", "cascading_removal", "histogram", "network_nodes",
    "connected_components_whole", "clean_graph_whole", "pair_table", "method_tau_matrix", "scatter_fit", "augmented_graph", "metric_table",
]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    from spreadrank.plans import catalog, oracles

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    ours, theirs = catalog.QUERIES[name](spark, DATA).toPandas(), con.sql(oracles.SQL[name]).df()
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    key = lambda df: sorted(tuple(None if x != x else x for x in r) for r in df[columns].itertuples(index=False))
    assert key(ours) == key(theirs)


def test_entry_points(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    if os.path.isdir(DATA):
        assert e.entry(spark).count() > 0


def test_a_whole_study(spark, tmp_path):
    from spreadrank.plans import pipeline

    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    from spreadrank.sources.edges import co_return_edges

    path = tmp_path / "edges.txt"
    path.write_text("# u v\n" + "\n".join(f"{r.u} {r.v}" for r in co_return_edges(spark, DATA).where("u <= 60 and v <= 60").collect()))
    done, missing = pipeline.run(spark, {"Small-Graph": str(path), "Gone": str(tmp_path / "none")}, str(tmp_path / "out"))
    assert missing == ["Gone"] and (tmp_path / "out" / "small_graph_metrics").is_dir()
    assert done["Small-Graph"]["significance"].count() == 28 and done["Small-Graph"]["metrics"].count() == 8


def test_balls_and_path_disruption_of_all_nodes(spark, monkeypatch):
    import random

    from spreadrank.plans import catalog, inputs

    rng = random.Random(4)
    edges = sorted({tuple(sorted(rng.sample(range(40), 2))) for _ in range(48)})
    monkeypatch.setattr(inputs, "co_return_edges", lambda spark, sf_dir: spark.createDataFrame(edges, "u long, v long"))
    nbr = {}
    for u, v in edges:
        nbr.setdefault(u, set()).add(v)
        nbr.setdefault(v, set()).add(u)

    def reach(s, inside):
        dist, queue = {s: 0}, [s]
        for x in queue:
            for y in nbr[x] & inside - set(dist):
                dist[y] = dist[x] + 1
                queue.append(y)
        return dist

    def means(inside):
        """Mean distances of the largest components."""
        parts = {frozenset(reach(s, inside)) for s in inside}
        most = max(map(len, parts), default=0)
        return [sum(sum(reach(s, set(p)).values()) for s in p) / max(1, most * (most - 1)) for p in parts if len(p) == most] or [0.0]

    size, without, caspi = {}, {}, {}
    for c in nbr:
        ball = {x for x, d in reach(c, set(nbr)).items() if d <= 2}
        size[c] = sum(u in ball and v in ball for u, v in edges)
        without[c] = sum(u in ball - {c} and v in ball - {c} for u, v in edges)
        (whole,) = means(ball)
        caspi[c] = {round(abs(whole - x) / whole, 6) for x in means(ball - {c})}
    got = lambda name: {r[0]: r[1] for r in catalog.QUERIES[name](spark, DATA).collect()}
    assert got("ball_sizes_all") == size and got("ball_sizes_all_no_center") == {c: n for c, n in without.items() if n}
    found = got("path_disruption")
    assert set(found) == set(nbr) and all(round(found[c], 6) in caspi[c] for c in nbr)
