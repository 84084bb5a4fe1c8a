"""hostgraph — Spark-native host-graph analytics over source -> destination flow tables.

Every operator is a ``DataFrame -> DataFrame`` function built from the DataFrame / SQL
API so Catalyst can prune, push down and plan the shuffles.  Sub-packages:

* ``sources``   — table loaders, the canonical flow view, CSV scan, sinks
* ``functions`` — column expressions (timestamp parsing, bucketing, labels, IP tests)
* ``operators`` — profiling, cleaning, edges, host features, PageRank, clustering,
                  enrichment joins, novelty, chain reconstruction, MTTD, splits,
                  metrics, ML stages
* ``plans``     — end-to-end compositions and the query catalog (Spark + oracle SQL)
* ``streaming`` — Structured Streaming variants of the edge and novelty operators
"""

__version__ = "0.1.0"
