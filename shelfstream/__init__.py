"""Spark-native analytics for multi-tenant product search, metering and commerce."""
