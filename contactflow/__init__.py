"""Pairwise pose-track contact analytics as Spark DataFrame operators."""
