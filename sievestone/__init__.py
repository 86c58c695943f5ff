"""sievestone: a Spark-first engine for provenance-bound text corpora."""
