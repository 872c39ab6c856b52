"""docmill: document-corpus analytics expressed as composable Spark DataFrame operators."""
