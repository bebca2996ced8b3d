"""Sylvan: Spark-native analytics for collections of trees, alignments and distance matrices."""
