"""tidemark: ordered, keyed observations as composable Spark DataFrame operators."""
