"""A PySpark-native engine for typed, nested graph queries over relational tables."""
