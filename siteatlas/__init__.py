"""Website-evidence analytics as Spark DataFrame operations."""
