"""The whole study of one graph: scores, evaluation, experiments and result files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.session import cut
from ..operators import centrality, evaluate, experiments, features, graph, influence, learn, report, similarity, spread
from ..sources import edges as source
from ..sources import sinks


def score_graph(edges: DataFrame, depth: int = 2, alpha: float = 0.6, top_k: int = 10, max_iter: int = 100, tol: float | None = 1e-6):
    """(adj, parts): adjacency, and components with the equally weighted score."""
    adj = cut(graph.adjacency(edges))
    raw = cut(features.node_features(edges, max_iter, tol))
    scaled = features.scaled_features(raw).select("node_id", F.array(*[F.col(f"{c}_norm") for c in features.NAMES]).alias("x"))
    ga = cut(similarity.augmented_graph(adj, similarity.cosine_topk(scaled, top_k), alpha, top_k))
    return adj, cut(influence.influence_components(adj, ga, depth))


#: The tables of a study.
TABLES = (
    "stats", "influence", "weights", "scores", "all_scores", "metrics", "ranked_nodes", "report", "significance", "tau_vs_rate", "classification", "removal",
    "ablation", "ablation_curves", "cascade", "error_bars", "tau_matrix", "box_stats", "scatter_fit", "quintiles", "histogram_score", "histogram_sir", "pair_table",
)


def study(edges: DataFrame, name: str, sample: int = 200, k: int = 10, truth_runs: int = 10, runs: int = 15, rates: tuple[float, ...] = tuple(i / 100 for i in range(1, 11))) -> dict[str, DataFrame]:
    """All result tables of a cleaned graph, lazily where they do not feed each other."""
    adj, parts = score_graph(edges)
    nodes = graph.degrees(adj).select("node_id")
    n = nodes.count()
    taught = evaluate.hash_sample(nodes, max(10, n // 5), salt=5)
    weights = cut(learn.learn_weights(parts, spread.node_influence(adj, taught, runs=truth_runs)).withColumn("dataset", F.lit(name)))
    xi = weights.first()
    fixed = parts.select(F.lit("influence_fixed").alias("method"), "node_id", "score")
    learned = influence.weighted_score(parts.drop("score"), (xi["x1"], xi["x2"], xi["x3"], xi["x4"])).select(F.lit("influence_adaptive").alias("method"), "node_id", "score")
    scores = cut(centrality.all_baselines(adj).union(fixed).union(learned))
    probe = cut(spread.node_influence(adj, evaluate.hash_sample(nodes, sample if n > 500 else n), runs=truth_runs))
    scored = cut(evaluate.on_sample(scores, probe))
    methods = list(evaluate.ORDER)
    adaptive = scores.where("method = 'influence_adaptive'")
    seeds = evaluate.top_k(scores, k).select(F.col("method").alias("label"), "node_id")
    final = spread.spread_curve(adj, seeds, runs=25).groupBy(F.col("label").alias("method")).agg(F.max_by("f", "t").alias("f_final"))
    return {
        "stats": graph.graph_stats(edges), "influence": parts, "weights": weights, "scores": report.wide_scores(scores, methods), "all_scores": report.all_scores(scores, methods, probe),
        "metrics": experiments.metric_table(adj, scores, scored, k, runs=runs), "ranked_nodes": report.ranked_nodes(report.with_truth(scores, nodes, probe), ["SIR", *methods]),
        "report": evaluate.comparison_report(scored, scores, final, k, 10), "ablation_curves": experiments.ablation_curves(adj, parts, k, runs=runs),
        "quintiles": report.quintiles(adaptive), "histogram_score": report.histogram(adaptive, "score"), "histogram_sir": report.histogram(probe, "sir"),
        "pair_table": report.pair_table(scores, methods, "influence_adaptive"),
        "significance": evaluate.wilcoxon(scored), "tau_vs_rate": evaluate.tau_vs_rate(adj, scores, evaluate.hash_sample(nodes, 150 if n > 500 else n), list(rates), runs=truth_runs),
        "classification": evaluate.all_metrics(scored, k), "removal": experiments.node_removal(edges, adaptive, k, runs=runs), "ablation": experiments.ablation(parts, probe, k),
        "cascade": experiments.cascading_removal(edges, scores.where("method in ('influence_adaptive', 'DC')")), "error_bars": experiments.repeated_spread(adj, scores, k),
        "tau_matrix": evaluate.tau_matrix(scores), "box_stats": report.box_stats(scores), "scatter_fit": report.scatter_fit(scored),
    }


def write_study(tables: dict[str, DataFrame], name: str, folder: str) -> list[str]:
    """One CSV folder for each table, named after the dataset."""
    return [sinks.write_csv(df, f"{folder}/{sinks.slug(name)}_{what}") for what, df in tables.items()]


def run(spark, datasets: dict[str, str], folder: str) -> tuple[dict[str, dict[str, DataFrame]], list[str]]:
    """Studies of all edge lists that exist, written under folder; and the names of the missing ones."""
    done, missing = {}, []
    for name, path in datasets.items():
        pairs, gone = source.read_datasets(spark, {name: path})
        if gone:
            missing += gone
            continue
        done[name] = study(cut(graph.clean_graph(pairs.select("u", "v"))), name)
        write_study(done[name], name, folder)
    return done, missing
