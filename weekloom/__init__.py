"""weekloom: event-driven factor research as typed Spark DataFrame operations."""
