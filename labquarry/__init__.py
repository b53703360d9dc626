"""A PySpark-native analytics engine for scientific and laboratory tables."""
