"""Versioned key-value analytics on Spark: an append-only log of puts and deletes as DataFrames."""
