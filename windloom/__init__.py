"""windloom: Spark-native evidence retrieval, document processing and polar analytics."""
