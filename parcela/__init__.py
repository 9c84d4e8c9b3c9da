"""Property-market analytics and corpus preparation, written as Spark jobs."""
