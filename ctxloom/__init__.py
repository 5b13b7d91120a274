"""ctxloom: a Spark-native engine for code-context retrieval and corpus processing."""
