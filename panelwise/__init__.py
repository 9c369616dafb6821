"""Panel risk analytics on Spark: one row per entity per period, next-period outcome, drift and scoring."""
