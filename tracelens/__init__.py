"""Batch-job trace and telemetry analytics as Spark DataFrame operators."""
