"""Spark-first analytics over origin-destination trip graphs."""
