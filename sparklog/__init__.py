"""A PySpark-native analytics engine for logs and event data."""
