"""loomfield: a PySpark-native engine for web pages, records and training text."""
