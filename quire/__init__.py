"""quire: a PySpark-native engine for bibliographic integration and analytics."""
