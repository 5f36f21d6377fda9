import random

import numpy as np
from pyspark.sql import functions as F

from sievework.operators import metrics as E


def scored(spark, y, s):
    return spark.createDataFrame(list(zip(y, s, strict=True)), "y int, s double")


def test_auc(spark):
    get = lambda y, s: E.auc(scored(spark, y, s), "y", "s").first().auc
    assert get([0, 0, 1, 1], [0.1, 0.2, 0.8, 0.9]) == 1.0
    assert get([0, 0, 1, 1], [0.9, 0.8, 0.2, 0.1]) == 0.0
    assert get([1, 1], [0.1, 0.2]) == 0.5
    rng = random.Random(3)
    y, s = [rng.randrange(2) for _ in range(300)], [rng.randrange(20) / 4 for _ in range(300)]
    want = np.mean([(a > b) + 0.5 * (a == b) for a, p in zip(s, y, strict=True) if p for b, q in zip(s, y, strict=True) if not q])
    assert abs(get(y, s) - want) < 1e-12


def test_spearman(spark):
    df = spark.createDataFrame([(float(i), float(i * i), 1.0) for i in range(9)], "a double, b double, c double")
    assert E.spearman(df, "a", "b").first().rho > 0.99
    assert E.spearman(df, "a", "c").first().rho == 0.0
    assert E.spearman(df.limit(0), "a", "b").first().n == 0


def test_balanced_accuracy(spark):
    df = spark.createDataFrame([(0, 0), (0, 0), (0, 0), (1, 0)], "t int, g int")
    assert E.balanced_accuracy(df, "t", "g").first().balanced_accuracy == 0.5
    assert {(r.truth, r.guess): r.n for r in E.confusion(df, "t", "g").collect()} == {(0, 0): 3, (1, 0): 1}


def test_nearest_centroid(spark):
    rows = [(0, [0.0, 0.0], "a", True), (1, [0.2, 0.1], "a", True), (2, [5.0, 5.0], "b", True), (3, [5.1, 4.9], "b", True), (4, [0.1, 0.0], "a", False), (5, [4.0, 5.0], "b", False)]
    df = spark.createDataFrame(rows, "k long, v array<double>, l string, tr boolean")
    assert {r.k: r.guess for r in E.nearest_centroid(df, F.col("tr"), "k", "v", "l").collect()} == {4: "a", 5: "b"}


def test_even_subsample(spark):
    df = spark.range(10).withColumnRenamed("id", "i")
    assert sorted(r.i for r in E.even_subsample(df, ["i"], 4).collect()) == sorted({int(x) for x in np.linspace(0, 9, 4).round()})
