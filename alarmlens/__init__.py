"""alarmlens: Spark-first telemetry analytics (profiles, filters, change points, alarm evaluation)."""
