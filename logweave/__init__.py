"""Spark-native analytics of device logs and telemetry."""
