"""ledgerspark: a PySpark-native engine for question answering over report tables."""
