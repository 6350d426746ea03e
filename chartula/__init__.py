"""A PySpark-native engine for contextual-retrieval datasets."""
