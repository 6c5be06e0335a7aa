"""Rooted-triplet analytics for collections of phylogenetic trees, on Spark."""

__version__ = "0.1.0"
