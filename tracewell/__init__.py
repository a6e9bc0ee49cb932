"""Developer-activity, text and code-structure analytics on Spark."""
