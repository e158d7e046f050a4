"""PySpark-native price-intelligence analytics."""
