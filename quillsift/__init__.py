"""A Spark-native two-stage text-retrieval engine."""
