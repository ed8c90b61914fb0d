"""Registered queries of the graph engine: each takes (spark, sf_dir) and gives a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.session import cut
from ..operators import centrality, evaluate, experiments, features, graph, influence, learn, report, similarity, spread
from ..sources.edges import co_return_edges
from . import pipeline
from .inputs import BASELINES, DIGITS, RATE_SAMPLE, RATES, ROUNDS, RUNS, TRUTH_RUNS, Inputs, K


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Doubles to a fixed number of places, other numbers to long."""
    fix = {"double": lambda c: F.round(c, digits), "int": lambda c: F.col(c).cast("long")}
    return df.select(*[fix[t](c).alias(c) if t in fix else F.col(c) for c, t in df.dtypes])


def _query(build):
    return lambda spark, sf_dir: rounded(build(Inputs(spark, sf_dir)))


def _values(build, name="value"):
    return _query(lambda i: build(i.adj).select("node_id", F.col(name).cast("double").alias("value")))


def _thin(i: Inputs) -> DataFrame:
    return co_return_edges(i.spark, i.sf_dir, 0.05)


def _top5(i: Inputs) -> DataFrame:
    dc = i.only("DC")
    return cut(evaluate.ranks(dc).where("rn <= 5").select("node_id", F.col("rn").alias("rank")))


def _dc_top(i: Inputs, k: int = K) -> DataFrame:
    return evaluate.top_k(i.only("DC"), k)


def _curve(i: Inputs) -> DataFrame:
    seeds = evaluate.top_k(i.scores, K).select(F.col("method").alias("label"), "node_id")
    return spread.spread_curve(i.adj, seeds, runs=RUNS)


def _final(i: Inputs) -> DataFrame:
    return _curve(i).groupBy(F.col("label").alias("method")).agg(F.max_by("f", "t").alias("f_final"))


def _metrics(i: Inputs) -> DataFrame:
    n = i.nodes.count()
    return spread.curve_metrics(_curve(i), n).withColumnRenamed("label", "method")


def _embeddings(i: Inputs) -> DataFrame:
    e = i.spark.read.parquet(f"{i.sf_dir}/embeddings.parquet")
    return similarity.cosine_topk(e.select(F.col("vec_id").alias("node_id"), F.col("embedding").cast("array<double>").alias("x")))


def _top20(i: Inputs) -> DataFrame:
    return path_top(i, 20, 2)


def path_top(i: Inputs, m: int, depth: int) -> DataFrame:
    centers = evaluate.top_k(i.only("DC"), m).select("node_id")
    return influence.path_disruption(i.adj, centers, depth)


def _radar(i: Inputs) -> DataFrame:
    m = evaluate.roc_auc(evaluate.labelled(i.scored, K)).join(evaluate.tau_against_truth(i.scored), "method").join(evaluate.precision_at_k(i.scored, K), "method")
    return report.radar(m.join(_final(i), "method").select("method", "tau", "p_at_k", "auc", "f_final"))


def _network(i: Inputs) -> DataFrame:
    dc = i.only("DC").select("node_id", "score")
    rn = evaluate.ranks(i.only("DC"))
    return report.network_nodes(graph.ego_subgraph(i.adj, _top5(i)), dc, rn)


def _influence(i: Inputs) -> DataFrame:
    return i.parts.select("node_id", "cli", F.round("csli", 6).alias("csli"), "caspi", "csi", "score")


def _taus(i: Inputs) -> DataFrame:
    return evaluate.tau_vs_rate(i.adj, i.scores, evaluate.hash_sample(i.nodes, RATE_SAMPLE), list(RATES), runs=TRUTH_RUNS)


def _removal(i: Inputs) -> DataFrame:
    return experiments.node_removal(i.edges, i.only("DC"), K, runs=RUNS)


def _removal_summary(i: Inputs) -> DataFrame:
    return experiments.removal_summary(_removal(i), i.nodes.count(), i.nodes.count() - K)


def _weights(i: Inputs) -> DataFrame:
    return learn.learn_weights(i.parts, i.truth).withColumn("dataset", F.lit("co_return"))


def _communities(i: Inputs) -> DataFrame:
    shown = graph.ego_subgraph(i.adj, _top5(i), 300)
    return graph.communities(graph.induced(i.edges, shown))


QUERIES = {
    "edge_projection": _query(lambda i: i.edges),
    "adjacency": _query(lambda i: i.adj),
    "graph_stats": _query(lambda i: graph.graph_stats(i.edges)),
    "connected_components_whole": _query(lambda i: graph.connected_components(i.edges)),
    "largest_component_whole": _query(lambda i: graph.largest_component(i.edges)),
    "clean_graph_whole": _query(lambda i: graph.clean_graph(i.edges)),
    "connected_components": _query(lambda i: graph.connected_components(_thin(i))),
    "largest_component": _query(lambda i: graph.largest_component(_thin(i))),
    "clean_graph": _query(lambda i: graph.clean_graph(_thin(i))),
    "hop_layers_l2": _query(lambda i: graph.hop_layers(i.adj, i.nodes, 2).groupBy("src", "dist").agg(F.count(F.lit(1)).alias("n_nodes"))),
    "ball_sizes": _query(lambda i: graph.balls(i.adj, _dc_top(i).select("node_id"), 2).groupBy("center").agg(F.count(F.lit(1)).alias("n_edges"))),
    "ball_sizes_no_center": _query(lambda i: graph.balls(i.adj, _dc_top(i).select("node_id"), 2, center=False).groupBy("center").agg(F.count(F.lit(1)).alias("n_edges"))),
    "ball_sizes_all": _query(lambda i: graph.balls(i.adj, i.nodes, 2).groupBy("center").agg(F.count(F.lit(1)).alias("n_edges"))),
    "ball_sizes_all_no_center": _query(lambda i: graph.balls(i.adj, i.nodes, 2, center=False).groupBy("center").agg(F.count(F.lit(1)).alias("n_edges"))),
    "ego_subgraph_top5": _query(lambda i: graph.induced(i.edges, graph.ego_subgraph(i.adj, _top5(i)))),
    "remove_top10": _query(lambda i: graph.without(i.edges, _dc_top(i))),
    "communities": _query(_communities),
    "node_degree_features": _query(lambda i: features.degree_features(i.adj)),
    "clustering": _values(features.clustering, "clustering"),
    "kcore": _values(features.core_numbers, "core"),
    "local_efficiency": _values(features.local_efficiency, "local_eff"),
    "local_efficiency_standard": _values(lambda a: features.local_efficiency(a, "standard"), "local_eff"),
    "pagerank_20": _values(lambda a: features.pagerank(a, max_iter=ROUNDS, tol=None), "pagerank"),
    "node_features": _query(lambda i: features.node_features(i.edges, adj=i.adj)),
    "minmax_features": _query(lambda i: features.scaled_features(features.degree_features(i.adj), features.NAMES[:3])),
    "cosine_topk_embeddings": _query(_embeddings),
    "augmented_graph": _query(lambda i: i.blended),
    "local_influence": _values(influence.local_influence, "cli"),
    "semilocal_influence": _query(lambda i: influence.semilocal_influence(i.adj, i.blended).withColumn("csli", F.round("csli", 6))),
    "path_disruption_top20": _query(_top20),
    "path_disruption": _query(lambda i: influence.path_disruption(i.adj, depth=2)),
    "path_disruption_l1": _query(lambda i: influence.path_disruption(i.adj, depth=1)),
    "semantic_influence": _query(lambda i: influence.semantic_influence(i.blended)),
    "influence_score": _query(_influence),
    "degree_centrality": _values(centrality.degree_centrality),
    "betweenness": _values(centrality.betweenness),
    "closeness": _values(centrality.closeness),
    "collective_influence": _values(centrality.collective_influence),
    "wide_scores": _query(lambda i: report.wide_scores(i.scores, list(BASELINES))),
    "all_scores": _query(lambda i: report.all_scores(i.scores, list(BASELINES), i.truth)),
    "ranked_nodes_top20": _query(lambda i: report.ranked_nodes(report.with_truth(i.scores, i.nodes, i.truth), ["SIR", *BASELINES])),
    "top_bars": _query(lambda i: report.top_bars(i.scores)),
    "hash_sample_200": _query(lambda i: evaluate.hash_sample(i.nodes, 200)),
    "score_quintiles": _query(lambda i: report.quintiles(i.only("CI"))),
    "sir_curve": _query(_curve),
    "sir_single_seed": _query(lambda i: i.truth),
    "spread_metrics": _query(_metrics),
    "sir_recovery_half": _query(lambda i: spread.slow_recovery_curve(i.adj, _dc_top(i).select(F.lit("DC").alias("label"), "node_id"), runs=3)),
    "kendall_tau": _query(lambda i: evaluate.tau_against_truth(i.sampled)),
    "method_tau_matrix": _query(lambda i: evaluate.tau_matrix(i.scores)),
    "precision_at_k": _query(lambda i: evaluate.precision_at_k(i.sampled, K)),
    "wilcoxon_z": _query(lambda i: evaluate.wilcoxon(i.sampled).select("method_a", "method_b", "n", "w", "z")),
    "significance": _query(lambda i: evaluate.wilcoxon(i.sampled).select("method_a", "method_b", "p_value", "significant")),
    "comparison_report": _query(lambda i: evaluate.comparison_report(i.scored, i.scores, _final(i), K)),
    "tau_vs_lambda": _query(_taus),
    "tau_rate_matrix": _query(lambda i: report.rate_matrix(_taus(i), list(RATES))),
    "all_metrics": _query(lambda i: evaluate.all_metrics(i.sampled, K)),
    "top_k_labels": _query(lambda i: evaluate.labelled(i.sampled, K).select("method", "node_id", "truth", "predicted")),
    "roc_auc": _query(lambda i: evaluate.roc_auc(evaluate.labelled(i.sampled, K))),
    "average_precision": _query(lambda i: evaluate.average_precision(evaluate.labelled(i.sampled, K))),
    "threshold_curve": _query(lambda i: evaluate.threshold_curve(evaluate.labelled(i.sampled, K))),
    "confusion": _query(lambda i: evaluate.confusion(evaluate.labelled(i.sampled, K))),
    "classification": _query(lambda i: evaluate.classification(evaluate.labelled(i.sampled, K))),
    "weight_grid": _query(lambda i: learn.losses(i.parts, i.truth, learn.candidates(i.spark))),
    "weight_learned": _query(lambda i: learn.learn_weights(i.parts, i.truth)),
    "weights_summary": _query(lambda i: report.weights_summary(_weights(i))),
    "weight_matrix": _query(lambda i: report.weight_matrix(_weights(i))),
    "mean_improvement": _query(lambda i: learn.mean_improvement(_weights(i))),
    "weight_gradient": _query(lambda i: learn.learn_weights(i.parts, i.truth, "gradient")),
    "node_removal": _query(_removal),
    "removal_summary": _query(_removal_summary),
    "ablation": _query(lambda i: experiments.ablation(i.parts, i.truth, K)),
    "component_gain": _query(lambda i: experiments.component_gain(experiments.ablation(i.parts, i.truth, K))),
    "metric_table": _query(lambda i: experiments.metric_table(i.adj, i.scores, i.scored, K, runs=RUNS)),
    "cascading_removal": _query(lambda i: experiments.cascading_removal(i.edges, i.only("DC", "CI"), 4, runs=RUNS)),
    "sir_error_bars": _query(lambda i: experiments.repeated_spread(i.adj, i.scores, K, 3, 3)),
    "curve_heatmap": _query(lambda i: report.curve_heatmap(_curve(i))),
    "box_stats": _query(lambda i: report.box_stats(i.scores)),
    "violin_quantiles": _query(lambda i: report.violin_quantiles(i.scores)),
    "radar": _query(_radar),
    "histogram": _query(lambda i: report.histogram(i.only("CI"), "score")),
    "scatter_fit": _query(lambda i: report.scatter_fit(i.sampled).withColumn("slope", F.round("slope", 6))),
    "pair_table": _query(lambda i: report.pair_table(i.scores, list(BASELINES), "CI")),
    "network_nodes": _query(_network),
    "network_edges": _query(lambda i: graph.induced(i.edges, graph.ego_subgraph(i.adj, _top5(i), 100))),
}

#: Tables of the study that are queries; the others are the same operators on the same tables.
REGISTERED = ("influence", "weights", "scores", "metrics", "report", "significance", "tau_vs_rate", "classification", "ablation_curves", "histogram_score", "pair_table")
_studies: dict = {}


def _study(name: str):
    """A table of the whole study of the co-return graph: seven features, path disruption to two hops, all eight methods."""

    def run(spark, sf_dir: str) -> DataFrame:
        key, folder = (spark.sparkContext.applicationId, sf_dir), spark.sparkContext._jsc.sc().getCheckpointDir()
        if folder.isDefined():  # its tables are cut once and shared as long as their files are there
            path = spark._jvm.org.apache.hadoop.fs.Path(folder.get())
            if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
                _studies.clear()
        if key not in _studies:
            _studies.clear()
            _studies[key] = pipeline.study(cut(graph.clean_graph(co_return_edges(spark, sf_dir))), "co_return")
        return rounded(_studies[key][name])

    return run


QUERIES |= {f"study_{name}": _study(name) for name in pipeline.TABLES if name in REGISTERED}
