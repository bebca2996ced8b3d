"""Relational operators on distance edges, partitions, trees and alignments."""
