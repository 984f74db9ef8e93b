"""spanloom: Spark-native analytics over the query traffic sent to a data warehouse."""
