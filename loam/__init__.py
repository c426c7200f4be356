"""loam: a PySpark-native engine for retrieval corpora and training-data preparation."""
