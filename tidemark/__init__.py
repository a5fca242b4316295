"""A PySpark-native engine for news-driven market analytics."""
