"""casegraph: security-event analytics expressed as Spark DataFrame operations."""
