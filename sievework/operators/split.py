"""Hash-stable group split with holdout routing, and leakage queries over its result."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.functions.exprs import BENCHMARK_SOURCES, hash01, is_degraded, origin_key


def assign_splits(df: DataFrame, generators: Sequence[str] = (), level3: Sequence[str] = (), sources: Sequence[str] = (), seed: int = 0) -> DataFrame:
    """df with column split set. Rows of one origin stay together; degraded fakes of test_a become test_e.

    Four flags of each origin are combined before the shuffle; rows then meet their origin's base split in a join, which
    Spark broadcasts or splits by size, so that an origin with very many rows does not land in one task."""
    held = lambda column, values: F.max(F.coalesce(F.col(column).isin(list(values)), F.lit(False)) if values else F.lit(False))
    origin = origin_key(F.col("real_image_path"), F.col("image_path"))
    groups = df.groupBy(origin.alias("sieve_of")).agg(held("generator_name", generators).alias("g"), held("manipulation_level3", level3).alias("l"), held("source_dataset", sources).alias("s"), F.max("is_fake").alias("f"))
    real, fake = (hash01(F.col("sieve_of"), f"{kind}-{seed}") for kind in ("real", "fake"))
    base = (
        F.when(F.col("g"), "test_b").when(F.col("l"), "test_c").when(F.col("s"), "test_d")
        .when(F.col("f") == 0, F.when(real < 0.60, "train").when(real < 0.75, "val").otherwise("test_f"))
        .otherwise(F.when(fake < 0.70, "train").when(fake < 0.80, "val").otherwise("test_a"))
    )
    groups = groups.select("sieve_of", base.alias("sieve_base"))
    rows = df.withColumn("sieve_origin", origin).join(groups, F.col("sieve_origin").eqNullSafe(F.col("sieve_of")))
    moved = (F.col("sieve_base") == "test_a") & (F.col("is_fake") == 1) & is_degraded(F.col("postprocess"))
    return rows.withColumn("split", F.when(moved, "test_e").otherwise(F.col("sieve_base"))).drop("sieve_origin", "sieve_of", "sieve_base")


def _both_sides(df: DataFrame, key: Column, other: Column) -> DataFrame:
    """Keys that occur in train and on the other side: one aggregation in place of a join."""
    train = F.col("split") == "train"
    return df.groupBy(key.alias("key")).agg(F.max(train).alias("t"), F.max(other).alias("o")).where("t and o").select("key")


def leak_origin(df: DataFrame) -> DataFrame:
    return _both_sides(df.where("split is not null and split <> ''"), origin_key(F.col("real_image_path"), F.col("image_path")), F.col("split") != "train")


def leak_prompt_seed(df: DataFrame) -> DataFrame:
    rows = df.where("split is not null and split <> '' and prompt is not null and seed is not null")
    return _both_sides(rows, F.concat_ws("|", F.col("seed").cast("string"), "prompt"), F.col("split") != "train")


def leak_generator(df: DataFrame) -> DataFrame:
    return _both_sides(df.where("generator_name is not null and generator_name <> '' and split in ('train', 'test_b')"), F.col("generator_name"), F.col("split") == "test_b")


def leak_benchmark(df: DataFrame, benchmarks: Sequence[str] = BENCHMARK_SOURCES) -> DataFrame:
    return df.where((F.col("split") == "train") & F.col("source_dataset").isin(list(benchmarks))).groupBy(F.col("source_dataset").alias("key")).count().select("key")


def check_leakage(df: DataFrame, benchmarks: Sequence[str] = BENCHMARK_SOURCES) -> DataFrame:
    """rule, leaks, examples (three, in order) for every rule that finds any."""
    parts = {"origin": leak_origin(df), "prompt_seed": leak_prompt_seed(df), "generator": leak_generator(df), "benchmark": leak_benchmark(df, benchmarks)}
    found = None
    for rule, rows in parts.items():
        one = rows.select(F.lit(rule).alias("rule"), F.col("key").cast("string").alias("key"))
        found = one if found is None else found.unionByName(one)
    # Three smallest keys of a rule: a bounded list per rule.
    ranked = found.withColumn("n", F.row_number().over(Window.partitionBy("rule").orderBy("key"))).where("n <= 3").groupBy("rule").agg(F.sort_array(F.collect_list("key")).alias("examples"))
    return found.groupBy("rule").agg(F.count("*").alias("leaks")).join(ranked, "rule")
