"""Job telemetry analytics on Spark: accumulators, early-window features, encodings, drift, scoring."""
