"""Ridgeline: PySpark-native analytics for elevation-enriched path networks."""
