"""Sensor change-log analytics on Spark."""
