"""lectern: a Spark-first engine for building, checking and evaluating instruction corpora."""
