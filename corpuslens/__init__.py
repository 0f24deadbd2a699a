"""corpuslens: Spark-native analytics for document corpora."""
