"""Tables that the registered queries share, built from the test tables."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.session import cut
from ..operators import centrality, evaluate, features, graph, influence, similarity, spread
from ..sources.edges import co_return_edges

#: Parameters of the registered evaluation queries.
SAMPLE, RUNS, TRUTH_RUNS, ROUNDS, K = 200, 15, 10, 20, 10
RATES = tuple(i / 100 for i in range(1, 11))
RATE_SAMPLE = 150
BASELINES = ("DC", "BC", "CC", "CI", "PR", "KS")
DIGITS = 9


@dataclass
class Inputs:
    """Lazily built tables over one graph; each is cut once and shared by what follows."""

    spark: SparkSession
    sf_dir: str
    made: dict = field(default_factory=dict)

    def _once(self, name: str, build) -> DataFrame:
        if name not in self.made:
            self.made[name] = cut(build())
        return self.made[name]

    @property
    def edges(self) -> DataFrame:
        return self._once("edges", lambda: co_return_edges(self.spark, self.sf_dir))

    @property
    def adj(self) -> DataFrame:
        return self._once("adj", lambda: graph.adjacency(self.edges))

    @property
    def nodes(self) -> DataFrame:
        return graph.degrees(self.adj).select("node_id")

    @property
    def scores(self) -> DataFrame:
        """(method, node_id, score) of the six baselines, rounded."""
        build = lambda: centrality.all_baselines(self.adj, ROUNDS, None, BASELINES).select("method", "node_id", F.round("score", DIGITS).alias("score"))
        return self._once("scores", build)

    def only(self, *methods: str) -> DataFrame:
        """Scores of the named baselines alone."""
        build = lambda: centrality.all_baselines(self.adj, ROUNDS, None, methods).select("method", "node_id", F.round("score", DIGITS).alias("score"))
        return self._once("+".join(methods), build)

    @property
    def truth(self) -> DataFrame:
        """(node_id, sir) of the sampled nodes."""
        return self._once("truth", lambda: spread.node_influence(self.adj, evaluate.hash_sample(self.nodes, SAMPLE), runs=TRUTH_RUNS))

    @property
    def scored(self) -> DataFrame:
        return self._once("scored", lambda: evaluate.on_sample(self.scores, self.truth))

    @property
    def sampled(self) -> DataFrame:
        """The rows of scored, for queries that need no other: what a node can be scored by alone is worked out for these nodes only."""
        if "scores" in self.made:
            return self.scored
        build = lambda: centrality.all_baselines(self.adj, ROUNDS, None, BASELINES, self.truth).select("method", "node_id", F.round("score", DIGITS).alias("score"))
        return self._once("sampled", lambda: evaluate.on_sample(build(), self.truth))

    @property
    def features(self) -> DataFrame:
        """All seven scaled features as one vector, from values rounded so that they agree in any engine."""
        raw = features.node_features(self.edges, adj=self.adj).select("node_id", *[F.round(F.col(c).cast("double"), DIGITS).alias(c) for c in features.NAMES])
        return features.scaled_features(raw).select("node_id", F.array(*[F.col(f"{c}_norm") for c in features.NAMES]).alias("x"))

    @property
    def blended(self) -> DataFrame:
        return self._once("ga", lambda: similarity.augmented_graph(self.adj, similarity.cosine_topk(self.features)))

    @property
    def parts(self) -> DataFrame:
        """Influence components, semi-local to two hops and path disruption to one, scaled and rounded."""
        def build():
            made = influence.influence_components(self.adj, self.blended, path_depth=1)
            return made.select("node_id", *[F.round(c, DIGITS).alias(c) for c in (*influence.PARTS, *[f"{p}_norm" for p in influence.PARTS], "score")])

        return self._once("parts", build)
