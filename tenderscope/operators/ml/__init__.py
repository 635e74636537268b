"""Spark ML models and distributed anomaly detectors."""
