"""A PySpark-native engine for structural-variant analytics and training-data pipelines."""
