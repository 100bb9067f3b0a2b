"""quarry: Spark-first website-audit and keyword analytics."""
