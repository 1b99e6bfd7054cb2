"""A PySpark-native engine for approximate nearest-neighbour search over embedding columns."""
