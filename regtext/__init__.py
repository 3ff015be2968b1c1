"""A PySpark-native engine for regulatory and other structured text."""
