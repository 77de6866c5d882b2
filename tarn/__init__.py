"""tarn: a PySpark-native engine for log-structured lakehouse tables."""
