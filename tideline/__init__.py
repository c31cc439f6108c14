"""Expiry analytics on Spark: DataFrame operators for time-bounded rights."""
