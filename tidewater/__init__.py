"""Spark-first analytics for sharded, bursty search workloads."""
