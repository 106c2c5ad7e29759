"""Document-graph retrieval and analytics on Spark."""
