"""A Spark-native engine for keyed, versioned documents."""
