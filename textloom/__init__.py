"""textloom: a PySpark-native engine for analysing text corpora."""
