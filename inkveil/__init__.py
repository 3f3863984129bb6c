"""inkveil: Spark-native redaction of sensitive text and audit of large document collections."""
