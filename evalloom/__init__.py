"""Evaluation-telemetry and data-curation analytics on Spark."""
