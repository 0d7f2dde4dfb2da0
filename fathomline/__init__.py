"""Fathomline: telemetry analytics as composable PySpark DataFrame functions."""

__version__ = "0.1.0"
