"""Mutation logs over Parquet tables of events, orders, documents and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators.mvcc import DELETE, PUT


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def event_log(spark: SparkSession, folder: str) -> DataFrame:
    """(key, seq, op, value): an error event deletes its user, any other puts its value."""
    gone = F.coalesce(F.col("event_type") == "error", F.lit(False))
    return read(spark, folder, "events").select(F.col("user_id").alias("key"), (F.col("event_id") + 1).alias("seq"), F.when(gone, DELETE).otherwise(PUT).alias("op"), F.when(~gone, F.col("value")).alias("value"))


def text_key(key):
    """A user key as text that sorts like the number."""
    return F.concat(F.lit("user:"), F.lpad(key.cast("string"), 8, "0"))


def order_log(spark: SparkSession, folder: str) -> DataFrame:
    """Orders by customer: a finished order deletes."""
    gone = F.col("o_orderstatus") == "F"
    return read(spark, folder, "orders").select(F.col("o_custkey").alias("key"), (F.col("o_orderkey") + 1).alias("seq"), F.when(gone, DELETE).otherwise(PUT).alias("op"), F.when(~gone, F.col("o_totalprice")).alias("value"))


def document_log(spark: SparkSession, folder: str) -> DataFrame:
    """Documents by source: large values, few keys."""
    return read(spark, folder, "documents").select(F.col("source").alias("key"), (F.col("doc_id") + 1).alias("seq"), F.lit(PUT).alias("op"), F.col("text").alias("value"))


def turn_log(spark: SparkSession, folder: str) -> DataFrame:
    """Turns by conversation, versioned within each."""
    return read(spark, folder, "conversations").select(F.col("conv_id").alias("key"), F.col("turn").alias("seq"), F.lit(PUT).alias("op"), F.col("text").alias("value"))
