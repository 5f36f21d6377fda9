"""Estimators, ranks and near images against plain computations."""

import random

import numpy as np
from pyspark.sql import functions as F

from sievework.operators import estimators as E
from sievework.operators import gates, metrics, near_images, tables
from sievework.operators.order import with_position, with_running


def table(spark, n=120, d=3, seed=2):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    y = x @ np.arange(1, d + 1) + rng.normal(size=n) * 0.3 + 2
    return x, y, spark.createDataFrame([(i, x[i].tolist(), float(y[i]), f"g{i % 17}") for i in range(n)], "id long, x array<double>, y double, g string")


def test_positions_and_running_sums(spark):
    rng = random.Random(1)
    rows = [(rng.randint(0, 50), i, rng.randint(0, 9)) for i in range(500)]
    df = spark.createDataFrame(rows, "a int, b int, v int")
    order = sorted(rows)
    got = {(r.a, r.b): (r.position, r.s) for r in with_running(with_position(df, ["a", "b"]), ["a", "b"], {"s": "v"}).collect()}
    assert got == {r[:2]: (i, sum(x[2] for x in order[: i + 1])) for i, r in enumerate(order)}
    assert with_position(df.limit(0), ["a"]).count() == 0


def test_fits(spark):
    x, y, df = table(spark)
    wide = np.column_stack((x, np.ones(len(x))))
    m = E.moments(df, "x", "y")[()]
    assert np.allclose(np.append((w := E.least_squares(m)).coef, w.intercept), np.linalg.lstsq(wide, y, rcond=None)[0])
    mu, sd = x.mean(0), x.std(0) + 1e-8
    z = (x - mu) / sd
    coef = np.linalg.solve(z.T @ z + 2.0 * np.eye(3), z.T @ (y - y.mean()))
    got = df.select("id", E.ridge(m, 2.0).column(F.col("x")).alias("p")).orderBy("id").toPandas()["p"]
    assert np.allclose(got, z @ coef + y.mean())
    _, v = E.principal(m)
    assert np.allclose(np.abs(v), np.abs(np.linalg.svd(x - x.mean(0), full_matrices=False)[2][:2].T))


def test_isotonic(spark):
    rng = random.Random(4)
    points = [(rng.randint(0, 30) / 3, rng.random() + i / 60) for i in range(60)]
    df = spark.createDataFrame(points, "x double, y double")
    xs = sorted({p[0] for p in points})
    blocks = []
    for a in xs:  # pool adjacent violators, one point after another
        own = [p[1] for p in points if p[0] == a]
        blocks.append([sum(own) / len(own), len(own), [a]])
        while len(blocks) > 1 and blocks[-2][0] > blocks[-1][0]:
            v, w, m = blocks.pop()
            u = blocks[-1]
            blocks[-1] = [(u[0] * u[1] + v * w) / (u[1] + w), u[1] + w, u[2] + m]
    fit = {a: b[0] for b in blocks for a in b[2]}
    asked = [-5.0, 0.1, 3.3333, 4.05, 9.9, 50.0]
    got = E.isotonic(df, spark.createDataFrame([(a,) for a in asked], "x double"), "x", "y", "p").orderBy("x").toPandas()["p"]
    assert np.allclose(got, np.interp(asked, xs, [fit[a] for a in xs]))


def test_out_of_fold(spark):
    x, y, df = table(spark)
    got = {r.key: r for r in E.out_of_fold(df, "id", "x", "y", "g", splits=3, repeats=1, seed=5).collect()}
    fold = {r.id: r.fold for r in E.folds(df, "g", 3, 1, 5).collect()}
    assert len(got) == len(y) and len({(i % 17, f) for i, f in fold.items()}) == 17
    for f in set(fold.values()):
        test = np.array([fold[i] == f for i in range(len(y))])
        mu, sd = x[~test].mean(0), x[~test].std(0) + 1e-8
        z = (x[~test] - mu) / sd
        coef = np.linalg.solve(z.T @ z + np.eye(3), z.T @ (y[~test] - y[~test].mean()))
        want = (x[test] - mu) / sd @ coef + y[~test].mean()
        assert np.allclose([got[i].raw for i in np.flatnonzero(test).tolist()], want)
    assert E.rho(y, np.array([got[i].calibrated for i in range(len(y))])) > 0.9


def test_logistic(spark):
    x, y, df = table(spark)
    rows = df.withColumn("yes", (F.col("y") > 2).cast("int"))
    yes, mu, sd, w = (y > 2).astype(float), x.mean(0), x.std(0) + 1e-8, np.zeros(4)
    z = np.column_stack(((x - mu) / sd, np.ones(len(x))))
    for _ in range(7):
        p = 1 / (1 + np.exp(-z @ w))
        w -= 0.5 * (z.T @ (p - yes) / len(yes) + 1e-3 * np.append(w[:-1], 0) / len(yes))
    got = E.logistic(rows, "x", "yes", F.lit(True), rounds=7).orderBy("id").toPandas()["score"]
    assert np.allclose(got, 1 / (1 + np.exp(-z @ w)))


def test_bootstrap(spark):
    _, y, df = table(spark)
    draws = E.bootstrap(df, ["y"], {"n": lambda v: len(v), "mean": lambda v: v.mean()}, 300, "g", 3)
    assert {r.value for r in draws.where("name = 'n'").collect()} <= set(range(7 * 17, 8 * 17 + 1)) and draws.count() == 600
    found = {r.name: r for r in E.intervals(draws).collect()}
    assert found["mean"].low < y.mean() < found["mean"].high
    assert E.row_interval(df.limit(3), ["y"], lambda v: v.mean(), 20).first().low is None


def test_array_statistics():
    assert E.rho(np.array([1.0, 2, 3]), np.array([2.0, 2, 2])) == 0 and E.ranks(np.array([5, 1, 5])).tolist() == [2.5, 1, 2.5]
    assert E.ranked_auc(np.array([1, 0, 1]), np.array([0.2, 0.2, 0.9])) == 0.75 and E.ranked_auc(np.ones(3), np.ones(3)) == 0.5
    assert E.two_bucket(0.5)(np.array([0.1, 0.9, 0.8]), np.array([0.6, 0.7, 0.2])) == 0.25


def test_quantiles_and_centroids(spark):
    rng = np.random.default_rng(8)
    v = rng.integers(0, 9, 101) / 4
    df = spark.createDataFrame([(float(a), int(i % 3)) for i, a in enumerate(v)] + [(None, 0)], "v double, k int")
    got = metrics.quantiles(df, "v", (0.0, 0.37, 1.0)).first()
    assert np.allclose(got[:], np.quantile(v, (0, 0.37, 1)))
    x, _, rows = table(spark, 90, 4)
    rows = rows.withColumn("c", F.concat(F.lit("c"), F.col("id") % 3))
    train = np.arange(90) % 4 != 0
    z = (x - x[train].mean(0)) / (x[train].std(0) + 1e-8)
    cent = np.stack([z[train & (np.arange(90) % 3 == k)].mean(0) for k in range(3)])
    want = {i: f"c{((z[i] - cent) ** 2).sum(1).argmin()}" for i in np.flatnonzero(~train).tolist()}
    for at_once in (100_000, 4):
        assert {r.id: r.guess for r in metrics.nearest_centroid(rows, F.col("id") % 4 != 0, "id", "x", "c", at_once).collect()} == want


def test_near_images(spark):
    rng = random.Random(3)
    roots = [rng.getrandbits(64) for _ in range(12)]
    rows = []
    for i in range(160):
        h = rng.choice(roots)
        for _ in range(rng.randint(0, 4)):
            h ^= 1 << rng.randrange(64)
        rows.append((i, h - (1 << 64) if h >> 63 else h))
    df = spark.createDataFrame([*rows, (900, None)], "i int, phash long")
    far = lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count()
    values = sorted({h for _, h in rows})
    for t in (0, 1, 5):
        want = {(a, b) for a in values for b in values if a < b and far(a, b) <= t}
        assert {(r.a, r.b) for r in near_images.near_pairs(df, t).collect()} == want
        kept = []
        for i, h in rows:
            if all(far(h, k) > t for _, k in kept):
                kept.append((i, h))
        assert {r.i for r in near_images.greedy(df, "i", t).where("accepted").collect()} == {i for i, _ in kept}


def test_verdicts(spark):
    assert gates.recovery_verdict(0.6, 0.4, 0.7, 0.6, 0.1, 0.01)["verdict"] == "estimate"
    assert [gates.recovery_verdict(r, 0.1, 0.7, b, 0.3, -1)["verdict"] for r, b in ((0.4, 0.6), (0.4, 0.5), (0.2, 0.6))] == ["coarse grades", "ordinal statement", "withdrawn"]
    levels = spark.createDataFrame([(0.1, 0.3, 0.9), (0.3, 0.5, 0.5), (0.5, 0.7, 0.4)], "lo double, hi double, auc double")
    assert E.first_below(levels, "auc", 0.55).first().boundary == 0.4 and E.first_below(levels, "auc", 0.1).first().boundary is None


def test_gates_tell_planted_features(spark):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(240):
        op, s, fam = i % 3, (i % 5) / 5 + 0.1, i % 2
        rows.append((i, f"o{i % 40}", (np.array([s, op == 0, op == 1, 0.0]) + rng.normal(size=4) * 0.02).tolist(), s, f"op{op}", f"f{fam}", "test_b" if fam else "train", int(i % 4 > 0), s))
    df = spark.createDataFrame(rows, "image_id long, origin string, profile array<double>, strength double, operator string, generator_family string, split string, is_fake int, score double")
    one = gates.strength(df, 40).first()
    assert one.verdict == "PASS" and one.spearman_rho > 0.9
    two = gates.operators(df).first()
    assert two.verdict == "PASS" and two.same_model_acc == 1 and two.cross_model_acc == 1
    assert gates.strength(df.limit(3)).first().verdict == "FAIL"


def test_tables(spark):
    df = spark.createDataFrame([("a", 2, None), ("b", 1, "x"), ("c", 3, "y"), ("d", 1, "x")], "image_id string, n int, prompt string")
    assert [r.image_id for r in tables.head(df, 2, ["n", "image_id"]).collect()] == ["b", "d"] and tables.head(df, None, ["n"]).count() == 4
    assert [r.image_id for r in df.orderBy(*tables.nulls_last("prompt"), "image_id").collect()] == ["b", "d", "c", "a"]
    assert tables.filtered(df, {"n": 1}, text="X").count() == 2 and tables.first_offenders(df, F.lit("r"), "image_id", 3).first()[:] == ("r", 4, ["a", "b", "c"])
