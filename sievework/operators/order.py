"""Positions and running sums over a whole table without bringing it into one task.

Rows are range-partitioned by the order and written to the checkpoint folder; the parts' totals (one row a
part) give each part its offset, and what is left is done within parts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def written(df: DataFrame) -> DataFrame:
    """df, written to spark.checkpoint.dir (a folder of its own in local mode) and read from there."""
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(shared or tempfile.mkdtemp(prefix="sievework-"))
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """df as Parquet in the checkpoint folder, for what is read several times by few of its columns."""
    written(df.sparkSession.range(0))  # makes sure that there is a folder
    path = f"{df.sparkSession.sparkContext._jsc.sc().getCheckpointDir().get()}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def ranged(df: DataFrame, order: Sequence[str | Column]) -> DataFrame:
    """df sorted by parts of the order, with column sieve_part. Rows that are equal in the order share a part."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("sieve_part", F.spark_partition_id()))


def offsets(parts: DataFrame, totals: dict[str, Column]) -> DataFrame:
    """sieve_part and for each total the sum of it over the parts before."""
    each = parts.groupBy("sieve_part").agg(*[c.alias(n) for n, c in totals.items()])
    before = Window.orderBy("sieve_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a part
    return each.select("sieve_part", *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"sieve_{n}") for n in totals])


def with_position(df: DataFrame, order: Sequence[str | Column], name: str = "position") -> DataFrame:
    """df with each row's place (long, from 0) in the order; ties are numbered in any way."""
    parts = ranged(df, order)
    inside = F.row_number().over(Window.partitionBy("sieve_part").orderBy(*order)) - 1
    joined = parts.join(F.broadcast(offsets(parts, {"n": F.count(F.lit(1))})), "sieve_part")  # a row a part
    return joined.withColumn(name, (inside + F.col("sieve_n")).cast("long")).drop("sieve_part", "sieve_n")


def with_running(df: DataFrame, order: Sequence[str | Column], sums: dict[str, str]) -> DataFrame:
    """df with columns name: the sum of a column over this row and those before it, for each name -> column.

    The order must tell all rows apart."""
    parts = ranged(df, order)
    inside = Window.partitionBy("sieve_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = parts.join(F.broadcast(offsets(parts, {n: F.sum(c) for n, c in sums.items()})), "sieve_part")  # a row a part
    return joined.withColumns({n: F.sum(c).over(inside) + F.col(f"sieve_{n}") for n, c in sums.items()}).drop("sieve_part", *[f"sieve_{n}" for n in sums])
