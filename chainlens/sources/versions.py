"""A small table that is replaced as a whole: each version lies below v=<number> and counts once Spark has marked it whole.

One that a crash cut short is never read. The one before stays until the next is there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .snapshots import exists, names, remove


def numbers(spark: SparkSession, path: str) -> list[int]:
    return sorted(int(n[2:]) for n in names(spark, path) if n.startswith("v=") and exists(spark, f"{path}/{n}/_SUCCESS"))


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    found = numbers(spark, path)
    return spark.read.schema(schema).parquet(f"{path}/v={found[-1]}") if found else spark.createDataFrame([], schema)


def write(rows: DataFrame, path: str) -> int:
    """The next version; rows may be made from the one before. Returns its number."""
    spark = rows.sparkSession
    found = numbers(spark, path)
    number = found[-1] + 1 if found else 0
    rows.write.mode("overwrite").parquet(f"{path}/v={number}")
    for n in found[:-1]:
        remove(spark, f"{path}/v={n}")
    return number
