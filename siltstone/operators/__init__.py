"""Transformations of mutation logs, runs, write-ahead logs and manifests: DataFrame in, DataFrame out."""
