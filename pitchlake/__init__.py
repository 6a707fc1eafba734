"""pitchlake: season analytics on Spark.

Event-level fact tables (one row per pitch) are turned into per-entity,
per-season feature tables, then into model-ready tables, clusters and
nearest-neighbour lists. Every public function takes and returns Spark
DataFrames; the heavy work always runs on executors.

Layout
------
functions/   column expressions (cleaning, flags, conditional rates)
operators/   DataFrame -> DataFrame operators (dedupe, aggregates, joins,
             gold preprocessing, scaling/PCA, KNN, cluster metrics, mixtures)
sources/     lake layout, partitioned reads/writes, landing jobs
plans/       end-to-end jobs (silver, gold, clustering, similarity) and the
             small serving queries
streaming/   incremental bronze landing with Structured Streaming
"""

__version__ = "0.1.0"
