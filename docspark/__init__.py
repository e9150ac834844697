"""docspark: a PySpark-native engine for structuring digitised books and preparing text corpora."""
