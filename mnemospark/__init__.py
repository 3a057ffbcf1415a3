"""A Spark-native retrieval engine over personal text."""
