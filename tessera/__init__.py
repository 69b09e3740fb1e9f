"""tessera: a Spark-native engine for building, searching and evaluating text corpora."""
