"""Spark-first local-alignment search over large sequence collections."""
