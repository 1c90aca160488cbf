"""turnstone: a PySpark-native engine for dialogue, annotation and evaluation tables."""
