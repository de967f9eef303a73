"""storyloom: a PySpark-native engine for news and document streams."""
