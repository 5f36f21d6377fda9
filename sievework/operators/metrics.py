"""Rank metrics, class metrics and small estimators over tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.operators.order import with_position, with_running


def average_ranks(df: DataFrame, value: str) -> DataFrame:
    """Distinct values with count n and average rank.

    Ranks are made of the distinct values' counts, so a value that many rows have is one row here; they are
    summed over ranges of values, never in one task."""
    counts = df.groupBy(value).agg(F.count("*").alias("n"))
    return with_running(counts, [value], {"upto": "n"}).select(value, "n", (F.col("upto") - F.col("n") / 2.0 + 0.5).alias("rank"))


def auc(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve for each group, ties at average rank; 0.5 when a class is missing.

    Positives and negatives are counted per distinct score first; only those rows are ordered, all groups in
    one order, and what stands before a group is taken off again."""
    y = F.col(label) == 1
    counts = df.where(F.col(label).isNotNull() & F.col(score).isNotNull()).groupBy(*by, score).agg(F.count_if(y).alias("p"), F.count_if(~y).alias("q"))
    below = with_running(counts, [*by, score], {"upto": "q"}).withColumn("lower", F.col("upto") - F.col("q"))
    # As sums of whole numbers: twice the pairs won, and what earlier groups add to each.
    won = F.sum(F.col("p").cast("decimal(18,0)") * (2 * F.col("lower") + F.col("q")).cast("decimal(19,0)")) - 2 * F.min("lower") * F.sum("p")
    both = F.sum("p") * F.sum("q")
    area = F.when(both > 0, won.cast("double") / 2 / both).otherwise(0.5)
    return (below.groupBy(*by) if by else below).agg(area.alias("auc"), F.sum("p").alias("positives"), F.sum("q").alias("negatives"))


def separability(a: Column) -> Column:
    return F.greatest(a, 1 - a)


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """Rank correlation; 0 with fewer than two rows or a constant side."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).alias("x"), F.col(y).alias("y"))
    rx, ry = (average_ranks(rows, c).select(F.col(c), F.col("rank").alias(f"r{c}")) for c in ("x", "y"))
    rho = F.try_divide(F.covar_pop("rx", "ry"), F.stddev_pop("rx") * F.stddev_pop("ry"))
    return rows.join(rx, "x").join(ry, "y").agg(F.coalesce(F.nanvl(rho, F.lit(0.0)), F.lit(0.0)).alias("rho"), F.count("*").alias("n"))


def confusion(df: DataFrame, truth: str, guess: str) -> DataFrame:
    return df.groupBy(F.col(truth).alias("truth"), F.col(guess).alias("guess")).agg(F.count("*").alias("n"))


def balanced_accuracy(df: DataFrame, truth: str, guess: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean over true classes of recall."""
    recall = df.groupBy(*by, truth).agg(F.avg((F.col(truth) == F.col(guess)).cast("double")).alias("recall"))
    return (recall.groupBy(*by) if by else recall).agg(F.avg("recall").alias("balanced_accuracy"), F.count("*").alias("classes"))


@dataclass
class Centroids:
    """Means of classes over standardised dimensions."""

    classes: list
    mean: np.ndarray
    scale: np.ndarray
    centre: np.ndarray  # classes x dimensions


def centroids(df: DataFrame, vector: str, label: str) -> Centroids:
    """From one aggregation: sums by class and dimension, which is what a driver holds. Deviations are the population's,
    plus 1e-8."""
    cells = df.select(F.col(label).alias("cls"), F.posexplode(F.col(vector).cast("array<double>")).alias("dim", "v"))
    rows = cells.groupBy("cls", "dim").agg(F.count("v").alias("n"), F.avg("v").alias("m"), F.var_pop("v").alias("s")).orderBy("cls", "dim").collect()
    classes = list(dict.fromkeys(r["cls"] for r in rows))
    d = 1 + max((r["dim"] for r in rows), default=-1)
    n, m, s = (np.zeros((len(classes), d)) for _ in range(3))
    place = {c: i for i, c in enumerate(classes)}
    for r in rows:
        n[place[r["cls"]], r["dim"]], m[place[r["cls"]], r["dim"]], s[place[r["cls"]], r["dim"]] = r["n"], r["m"], r["s"]
    mean = (n * m).sum(0) / n.sum(0)
    scale = np.sqrt((n * (s + (m - mean) ** 2)).sum(0) / n.sum(0)) + 1e-8
    return Centroids(classes, mean, scale, (m - mean) / scale)


def nearest_centroid(df: DataFrame, train: Column, key: str, vector: str, label: str, at_once: int = 100_000) -> DataFrame:
    """key, label, guess of the rows that are not for training; ties (distances to 9 digits) go to the smaller class.

    A row is compared where it stands, with no shuffle; `at_once` numbers of centroids are part of the plan at a time."""
    known = centroids(df.where(train), vector, label)
    numbers = lambda x: F.array(*[F.lit(float(v)) for v in x])
    tests = df.where(~train).select(key, F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("x"))
    z = F.zip_with(F.zip_with("x", numbers(known.mean), lambda a, b: a - b), numbers(known.scale), lambda a, b: a / b)
    tests = tests.select(key, "label", z.alias("z"))
    best = F.lit(None)
    step = max(1, at_once // max(1, len(known.mean)))
    for c in range(0, len(known.classes), step):
        some = F.array(*[F.struct(F.lit(k).alias("cls"), numbers(v).alias("c")) for k, v in zip(known.classes[c : c + step], known.centre[c : c + step], strict=True)])
        near = F.transform(some, lambda k: F.struct(F.round(F.aggregate(F.zip_with("z", k["c"], lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda acc, v: acc + v), 9).alias("d"), k["cls"].alias("cls")))
        tests = tests.withColumn("best", F.array_min(near) if c == 0 else F.least("best", F.array_min(near)))
        best = F.col("best.cls")
    return tests.select(key, "label", best.alias("guess"))


def quantiles(df: DataFrame, value: str, shares: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Exact quantiles of each group, with linear interpolation, as columns q0050 and the like.

    Made of the distinct values' counts and their running sums, so no task holds a group's values."""
    keys = by or ["sieve_all"]
    rows = df.where(F.col(value).isNotNull())
    rows = rows if by else rows.withColumn("sieve_all", F.lit(0))
    counts = rows.groupBy(*keys, F.col(value).cast("double").alias("sieve_v")).agg(F.count("*").alias("n"))
    upto = with_running(counts, [*keys, "sieve_v"], {"upto": "n"})
    every = upto.groupBy(*[F.col(k).alias(f"of_{k}") for k in keys]).agg(F.min(F.col("upto") - F.col("n")).alias("base"), F.sum("n").alias("total"))
    same = [F.col(k).eqNullSafe(F.col(f"of_{k}")) for k in keys]
    joined = upto.join(every, reduce(lambda a, b: a & b, same))
    upto_here = F.col("upto") - F.col("base")
    found = []
    for q in shares:
        place = (F.col("total") - 1) * F.lit(float(q))
        low = F.min(F.when(upto_here > F.floor(place), F.col("sieve_v")))
        high = F.coalesce(F.min(F.when(upto_here > F.floor(place) + 1, F.col("sieve_v"))), low)
        part = F.max(place - F.floor(place))
        found.append((low + (high - low) * part).alias(f"q{int(round(q * 1000)):04d}"))
    out = joined.groupBy(*keys).agg(*found)
    return out if by else out.drop("sieve_all")


def adjacent_auc(df: DataFrame, level: str, score: str) -> DataFrame:
    """AUC of each level against the next one: every row is one level's positive and the next one's negative."""
    placed = with_position(df.select(level).where(F.col(level).isNotNull()).distinct(), [level], "sieve_i")
    pairs = placed.select(F.col(level).alias("lo"), (F.col("sieve_i") + 1).alias("i")).join(placed.select(F.col(level).alias("hi"), F.col("sieve_i").alias("i")), "i").drop("i")
    low = df.join(pairs, F.col(level) == F.col("lo")).select("lo", "hi", F.lit(0).alias("y"), F.col(score).alias("s"))
    high = df.join(pairs, F.col(level) == F.col("hi")).select("lo", "hi", F.lit(1).alias("y"), F.col(score).alias("s"))
    return auc(low.unionByName(high), "y", "s", ("lo", "hi")).select("lo", "hi", "auc")


def even_subsample(df: DataFrame, order: Sequence[str], m: int) -> DataFrame:
    """m evenly spaced rows of the order: positions round(i (n - 1) / (m - 1)), half to even."""
    ranked = with_position(df, order, "sieve_i")
    n = df.agg(F.count("*")).scalar()
    wanted = df.sparkSession.range(m).select(F.bround(F.col("id") * (n - 1) / F.lit(float(max(1, m - 1)))).cast("long").alias("sieve_i")).distinct()
    return ranked.join(F.broadcast(wanted), "sieve_i", "left_semi").drop("sieve_i")  # m rows
