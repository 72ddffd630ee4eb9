"""loam: a PySpark-native engine for cleaning, chunking, indexing and retrieving text corpora."""
