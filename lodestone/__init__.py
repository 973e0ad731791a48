"""A Spark-native engine for evidence retrieval, review and evaluation over document collections."""
