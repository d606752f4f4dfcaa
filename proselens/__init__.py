"""proselens: a PySpark-native engine that finds low-quality prose at scale."""
