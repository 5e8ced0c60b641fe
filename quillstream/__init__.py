"""A Spark-first engine for conversational memory analytics."""
