"""Document retrieval and extraction as Spark queries."""
