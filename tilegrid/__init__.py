"""PySpark-native engine for scoring and analysing tile-placement games."""
