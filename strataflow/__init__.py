"""A PySpark-native engine for multi-view reconstruction tables, point clouds and large text corpora."""
