"""A PySpark-native engine for document retrieval, corpus preparation and operations analytics."""
