"""Alerts of a watch, each kept once until it was sent, whatever is repeated."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import snapshots as source

PAYLOAD = "host_id STRING, pair_seq BIGINT, payload STRING"


def sink(outbox: str) -> Callable[[DataFrame, DataFrame, int], None]:
    """For watch(alert=...): payloads of a batch's pairs with a material change, in a folder of the batch.

    A batch that is repeated writes its folder anew. Pairs that an earlier batch has are left out, so a watch that
    starts over with new numbers tells nothing twice.
    """

    def put(changes: DataFrame, hosts: DataFrame, number: int) -> None:
        spark = changes.sparkSession
        earlier = payloads(spark, outbox).where(F.col("batch") < number).select("host_id", "pair_seq")
        found = source.alerts(changes, hosts).join(earlier, ["host_id", "pair_seq"], "left_anti")
        found.write.mode("overwrite").parquet(f"{outbox}/payloads/batch={number}")

    return put


def payloads(spark: SparkSession, outbox: str) -> DataFrame:
    """All payloads: host_id, pair_seq, payload, batch."""
    path = f"{outbox}/payloads"
    if not source.exists(spark, path):
        return spark.createDataFrame([], f"{PAYLOAD}, batch INT")
    return spark.read.schema(f"{PAYLOAD}, batch INT").parquet(path)


def pending(spark: SparkSession, outbox: str) -> DataFrame:
    """Payloads not yet confirmed."""
    path = f"{outbox}/sent"
    found = payloads(spark, outbox).drop("batch")
    return found.join(spark.read.schema("host_id STRING, pair_seq BIGINT").parquet(path), ["host_id", "pair_seq"], "left_anti") if source.exists(spark, path) else found


def confirm(sent: DataFrame, outbox: str) -> None:
    """Notes payloads (host_id, pair_seq) as sent; to note one again changes nothing."""
    sent.select("host_id", "pair_seq").write.mode("append").parquet(f"{outbox}/sent")
