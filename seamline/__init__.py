"""seamline: Spark-native anomaly analytics over tiles, vectors and scores."""
