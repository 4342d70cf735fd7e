"""The ledger of removed heads: of each host the newest document that was given up, so that what comes after still verifies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.history import merged_heads
from . import versions

LEDGER = "host_id STRING, removed_ns BIGINT, removed_path STRING, expected_prev_hash STRING"


def read(spark: SparkSession, path: str) -> DataFrame:
    """host_id, removed_ns, removed_path, expected_prev_hash; no rows where nothing was ever given up."""
    return versions.read(spark, path, LEDGER)


def add(spark: SparkSession, path: str, heads: DataFrame) -> None:
    """Takes further removed heads in; a host's later one stands. Doing it again changes nothing."""
    versions.write(merged_heads(read(spark, path), heads), path)
