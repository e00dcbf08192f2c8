"""A PySpark-native engine for document and text processing."""
