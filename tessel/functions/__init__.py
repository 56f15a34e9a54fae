"""Part of tessel, a Spark-native hybrid retrieval engine."""
