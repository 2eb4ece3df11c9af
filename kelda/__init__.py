"""kelda: a Spark-first engine for procurement and lobbying records."""
