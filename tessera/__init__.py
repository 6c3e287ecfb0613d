"""tessera: a Spark-native engine for scoring agreement, text features and corpus preparation."""
