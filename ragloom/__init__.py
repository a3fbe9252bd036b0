"""ragloom: retrieval, evaluation and corpus preparation as Spark DataFrame jobs."""
