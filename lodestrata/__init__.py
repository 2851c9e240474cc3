"""A PySpark-native engine for mining open-data catalogues."""
