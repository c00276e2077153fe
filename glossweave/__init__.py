"""A Spark-native engine for building parallel-text corpora: divisions, segments, alignments, editions."""
