"""loomspark: a Spark-native engine for literature corpora."""
