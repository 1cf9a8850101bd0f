"""Spark-first analytics for networks of passive-radar receivers."""
