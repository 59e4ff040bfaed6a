"""A PySpark-native engine for preparing, checking and scoring reasoning datasets."""
