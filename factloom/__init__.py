"""factloom: Spark-native analytics over short textual facts."""
