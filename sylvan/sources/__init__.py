"""Readers and writers: alignments, trees, distance tables, parameters, partitions."""
