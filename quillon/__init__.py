"""Document retrieval and answer evaluation as Spark jobs."""
