"""A Spark-native engine for dated legal text and its citation graph."""
