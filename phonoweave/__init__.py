"""Ordered, context-sensitive rewrite-rule cascades over symbol sequences, on Spark."""
