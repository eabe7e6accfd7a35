"""Network panel analytics as DataFrame and SQL plans on Spark."""
