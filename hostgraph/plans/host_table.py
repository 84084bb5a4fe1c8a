"""Flows -> edges -> all 13 host-bucket features, as one lazy plan."""
from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import edges as E
from ..operators import features as FT
from ..session import materialize


def host_feature_table(flows: DataFrame, width: str = "1 hour",
                       with_graph_measures: bool = True, pagerank_kwargs: dict | None = None) -> DataFrame:
    edges = E.build_edges(flows, width)
    if not with_graph_measures:
        return FT.host_features(edges)
    from ..operators.clustering import clustering_coefficient
    from ..operators.pagerank import pagerank
    edges = materialize(edges)          # read by PageRank, clustering and the features
    pr = pagerank(edges, **(pagerank_kwargs or {}))
    cc = clustering_coefficient(edges)
    return FT.host_features(edges, pr, cc)
