"""A Spark-native engine for scoring text corpora and evaluating text detectors at scale."""
