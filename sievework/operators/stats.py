"""Descriptive statistics of a manifest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.functions.exprs import digitize, nongen_chain, nuisance_cell
from sievework.operators.rules import AREA_EDGES

FREQUENCIES = ("task_type", "generator_family", "generator_name", "operator", "split", "sample_kind", "compositing")


def totals(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("total"), F.count_if(F.col("is_fake") == 0).alias("real"), F.count_if(F.col("is_fake") == 1).alias("fake"), F.count_if(F.coalesce("mask_path", F.lit("")) != "").alias("with_mask"))


def frequencies(df: DataFrame, fields: Sequence[str] = FREQUENCIES) -> DataFrame:
    """field, value, n of all fields in one pass: rows are unpivoted map-side and combined before the shuffle."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields]))
    return df.select(pairs.alias("p")).where("p.value is not null and (p.value <> '' or p.field = 'task_type')").groupBy("p.field", "p.value").agg(F.count("*").alias("n"))


def chain_by_split(df: DataFrame) -> DataFrame:
    return df.where("split is not null and split <> ''").groupBy("split", nongen_chain(F.col("io_chain")).alias("chain")).agg(F.count_if(F.col("is_fake") == 0).alias("real"), F.count_if(F.col("is_fake") != 0).alias("fake"))


def by_nuisance_cell(df: DataFrame) -> DataFrame:
    return df.select(nuisance_cell(F.col("op_params")).alias("cell")).where("cell is not null").groupBy("cell").agg(F.count("*").alias("n"))


def by_area_bucket(df: DataFrame, edges: Sequence[float] = AREA_EDGES) -> DataFrame:
    return df.where("mask_area_ratio is not null").groupBy(F.concat(F.lit("b"), digitize(F.col("mask_area_ratio"), edges).cast("string")).alias("bucket")).agg(F.count("*").alias("n"))
