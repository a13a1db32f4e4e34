"""codeloom: code-intelligence analytics as Spark DataFrame jobs."""
