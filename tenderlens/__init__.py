"""Auditing of public contracts as Spark jobs: every operator is DataFrame in, lazy DataFrame out."""

__version__ = "0.1.0"
