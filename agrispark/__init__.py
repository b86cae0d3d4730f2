"""Field-sensor telemetry and agronomy-text analytics expressed as Spark DataFrame operators."""
