"""corpuslens: Spark-native analytics and search over long-form text corpora."""
