"""A PySpark-native engine for text analytics and decipherment over collections of documents."""
