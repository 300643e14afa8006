"""verdigris: Spark-native evaluation, retrieval and entity-resolution analytics."""
