"""weftline: a Spark-native context and retrieval engine."""
