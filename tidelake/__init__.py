"""tidelake: lakehouse table maintenance as Spark DataFrame workloads."""
