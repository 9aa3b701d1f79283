"""Tick and event time series on Spark: bars, ordered aggregates, as-of and window joins, a SQL dialect."""
