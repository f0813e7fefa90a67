"""Tidemark: a Spark-first analytics engine for conversation and event logs."""
