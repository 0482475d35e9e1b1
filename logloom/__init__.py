"""Log ingestion and analytics on Spark."""
