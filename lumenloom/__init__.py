"""lumenloom: a Spark-native retrieval and research-analytics engine."""
