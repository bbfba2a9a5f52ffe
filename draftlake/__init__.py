"""A Spark-native engine for match analytics and for training-data tables."""
