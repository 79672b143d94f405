"""A Spark-native engine for analysing grouped text corpora."""
