"""strandframe: a PySpark-native analytics engine for sequence collections."""
