"""recallgrid: a Spark-native engine for text rows with embeddings and a weighted, typed, time-valid edge table."""
