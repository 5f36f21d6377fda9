"""Small relational operators that audits and viewers use: facets, filters, lookups, ordered lists."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.functions.exprs import is_degraded

FACETS = ("split", "task_type", "manipulation_level1", "manipulation_level3", "generator_name", "operator")


def head(df: DataFrame, n: int | None, order: Sequence[str]) -> DataFrame:
    """The first n rows of the order; all of them without n."""
    return df if not n else df.orderBy(*order).limit(n)


def facets(df: DataFrame, columns: Sequence[str] = FACETS) -> DataFrame:
    """field, value, n: what each column holds, without nulls and empty texts, in one pass."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns]))
    return df.select(pairs.alias("p")).where("p.value is not null and p.value <> ''").groupBy("p.field", "p.value").agg(F.count("*").alias("n"))


def filtered(df: DataFrame, equal: Mapping[str, object] | None = None, is_fake: int | None = None, text: str = "", fields: Sequence[str] = ("image_id", "prompt")) -> DataFrame:
    """Rows that fit all facets, the kind, and hold the text in one of the fields (any case)."""
    for c, v in (equal or {}).items():
        df = df.where(F.col(c) == v)
    if is_fake is not None:
        df = df.where(F.col("is_fake") == is_fake)
    if text:
        found = F.lit(False)
        for c in fields:
            found = found | F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(text.lower()))
        df = df.where(found)
    return df


def nulls_last(column: str) -> list[Column]:
    """Sort keys: values as text, nulls behind them."""
    return [F.col(column).isNull(), F.col(column).cast("string")]


def sequence_of(df: DataFrame, order: Sequence[str | Column], by: Sequence[str], value: str) -> DataFrame:
    """by and the values of each group in the order (ties by value), as an array."""
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    return df.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)], F.col(value).alias("v")))), lambda s: s["v"]).alias("values"))


def first_offenders(df: DataFrame, rule: Column, shown: str, n: int = 5) -> DataFrame:
    """rule, total, first: the n smallest names of each rule's rows and how many there are; n names a task leave it."""
    rows = df.select(rule.alias("rule"), F.col(shown).cast("string").alias("name"))
    top = rows.groupBy("rule", F.pmod(F.xxhash64("name"), F.lit(64)).alias("part")).agg(F.slice(F.sort_array(F.collect_set("name")), 1, n).alias("some"), F.count("*").alias("n"))
    return top.groupBy("rule").agg(F.sum("n").alias("total"), F.slice(F.sort_array(F.flatten(F.collect_list("some"))), 1, n).alias("first"))


def masked(df: DataFrame, n: int, order: Sequence[str] = ("image_id",)) -> DataFrame:
    """The first n rows with a mask."""
    return head(df.where(F.coalesce("mask_path", F.lit("")) != ""), n, order)


def roundtrip_eligible() -> Column:
    return (F.col("sample_kind") == "real") & F.col("split").isin("train", "test_a", "test_f")


def consecutive_cosines(df: DataFrame, key: str, step: str, vector: str) -> DataFrame:
    """key, step, cosine of each vector with the next one of its key (0 if either has no length)."""
    follow = Window.partitionBy(key).orderBy(step)
    v = F.col("v")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)
    rows = df.select(key, step, F.col(vector).cast("array<double>").alias("v")).withColumn("w", F.lead("v").over(follow)).where("w is not null")
    norm = F.sqrt(dot(v, v) * dot(F.col("w"), F.col("w")))
    return rows.select(key, step, F.when(norm > 0, dot(v, F.col("w")) / norm).otherwise(0.0).alias("cosine"))


def on_shared(df: DataFrame, group: str, label: str) -> DataFrame:
    """Rows whose label occurs in every group."""
    n = df.select(group).where(F.col(group).isNotNull()).distinct().agg(F.count("*")).scalar()
    shared = df.groupBy(label).agg(F.count_distinct(group).alias("g")).where(F.col("g") == n).select(label)
    return df.join(shared, label, "left_semi")


def degraded_share(df: DataFrame) -> DataFrame:
    return df.groupBy("split").agg(F.avg(is_degraded(F.col("postprocess")).cast("double")).alias("share"))
