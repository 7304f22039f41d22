"""A permission-aware retrieval and corpus engine expressed as Spark jobs."""
