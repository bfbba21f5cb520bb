"""Panel time-series analytics on Spark: bars, indicators, patterns, back-tests, alerts."""
