"""Estimators fitted from sums, resampling, and what is read off their results.

A fit needs the sums of a table (counts, means, products), which tasks add up and which are as large as
dimensions x dimensions for each fold; rows never leave the executors. Only the bootstrap takes whole columns to
its tasks, and asks for their size first."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.functions.exprs import stable_hash
from sievework.operators.order import with_position, written

#: Rows of an evaluation that a bootstrap's tasks may each hold (three numbers a row).
BOOTSTRAP_ROWS_MOST = 5_000_000


@dataclass
class Moments:
    """Sums of rows: number, x, x x', y, x y, y y."""

    n: float
    x: np.ndarray
    xx: np.ndarray
    y: float
    xy: np.ndarray
    yy: float

    @staticmethod
    def of(flat: np.ndarray) -> Moments:
        d = int(np.sqrt(len(flat))) - 2
        m = flat.reshape(d + 2, d + 2)
        return Moments(m[0, 0], m[0, 1 : d + 1], m[1 : d + 1, 1 : d + 1], m[0, d + 1], m[1 : d + 1, d + 1], m[d + 1, d + 1])

    def __sub__(self, other: Moments) -> Moments:
        return Moments(self.n - other.n, self.x - other.x, self.xx - other.xx, self.y - other.y, self.xy - other.xy, self.yy - other.yy)


def moments(df: DataFrame, x: str, y: str, keys: Sequence[str] = ()) -> dict[tuple, Moments]:
    """Moments of each group of keys (a driver holds groups x (dimensions + 2)^2 numbers). Rows with nulls are left out."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*[F.col(k).cast("string").alias(f"k{i}") for i, k in enumerate(keys)], F.col(x).cast("array<double>").alias("x"), F.col(y).cast("double").alias("y"))
    names = [f"k{i}" for i in range(len(keys))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            values = np.asarray(batch.column("x").flatten(), np.float64).reshape(batch.num_rows, -1)
            wide = np.column_stack((np.ones(batch.num_rows), values, np.asarray(batch.column("y"))))
            group = list(zip(*(batch.column(k).to_pylist() for k in names), strict=True)) if names else [()] * batch.num_rows
            order: dict[tuple, list[int]] = {}
            for i, g in enumerate(group):
                order.setdefault(g, []).append(i)
            for g, at in order.items():
                part = wide[at]
                held[g] = held.get(g, 0) + part.T @ part
        ks = list(held)
        yield pa.RecordBatch.from_arrays([*(pa.array([k[i] for k in ks], pa.string()) for i in range(len(names))), pa.array([held[k].tobytes() for k in ks], pa.binary())], [*names, "sums"])

    out: dict[tuple, np.ndarray] = {}
    for r in rows.mapInArrow(run, ", ".join([*(f"{k} string" for k in names), "sums binary"])).toLocalIterator():  # a row a part and group
        key = tuple(r[:-1])
        out[key] = out.get(key, 0) + np.frombuffer(bytes(r["sums"]), np.float64)
    return {k: Moments.of(v) for k, v in out.items()}


@dataclass
class Linear:
    coef: np.ndarray
    intercept: float

    def column(self, x: Column) -> Column:
        return dot(x, self.coef) + F.lit(float(self.intercept))


def dot(x: Column, w: np.ndarray) -> Column:
    return F.aggregate(F.zip_with(x, F.array(*[F.lit(float(v)) for v in w]), lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v)


def least_squares(m: Moments) -> Linear:
    """Least squares with intercept, of minimum norm where rows do not decide."""
    xx = np.block([[m.xx, m.x[:, None]], [m.x[None, :], np.array([[m.n]])]])
    w = np.linalg.pinv(xx, rcond=1e-12, hermitian=True) @ np.append(m.xy, m.y)
    return Linear(w[:-1], float(w[-1]))


def ridge(m: Moments, alpha: float = 1.0) -> Linear:
    """Ridge over standardised features (population deviation + 1e-8); the intercept is not penalised."""
    mu = m.x / m.n
    sd = np.sqrt(np.maximum(np.diag(m.xx) / m.n - mu * mu, 0)) + 1e-8
    zz = (m.xx - m.n * np.outer(mu, mu)) / np.outer(sd, sd)
    zy = (m.xy - mu * m.y) / sd
    coef = np.linalg.solve(zz + alpha * np.eye(len(mu)), zy) / sd
    return Linear(coef, float(m.y / m.n - mu @ coef))


def principal(m: Moments, k: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Mean and the first k principal directions (dimensions x k), each with its largest entry positive."""
    mu = m.x / m.n
    _, v = np.linalg.eigh(m.xx / m.n - np.outer(mu, mu))
    v = v[:, ::-1][:, :k]
    return mu, v * np.sign(v[np.abs(v).argmax(0), np.arange(v.shape[1])])


def pca(df: DataFrame, x: str, k: int = 2) -> DataFrame:
    """df with columns pc1..pck: the centred rows' coordinates."""
    mu, v = principal(moments(df.withColumn("sieve_y", F.lit(0.0)), x, "sieve_y")[()], k)
    return df.withColumns({f"pc{i + 1}": dot(F.col(x), v[:, i]) - F.lit(float(mu @ v[:, i])) for i in range(v.shape[1])})


def logistic(df: DataFrame, x: str, y: str, train: Column, rounds: int = 300, rate: float = 0.5, shrink: float = 1e-3) -> DataFrame:
    """df with column score: a logistic regression by full-batch gradient steps over standardised features of the training
    rows. Each step is one aggregation; weights start at 0 and the intercept is not shrunk."""
    rows = written(df.withColumn("sieve_train", train))
    learn = rows.where("sieve_train")
    m = moments(learn, x, y)[()]
    mu = m.x / m.n
    sd = np.sqrt(np.maximum(np.diag(m.xx) / m.n - mu * mu, 0)) + 1e-8
    d, w = len(mu), np.zeros(len(mu) + 1)
    z = written(learn.select(*[((F.get(F.col(x), i) - float(mu[i])) / float(sd[i])).alias(f"z{i}") for i in range(d)], F.col(y).cast("double").alias("y")))
    for _ in range(rounds):
        margin = sum((F.col(f"z{i}") * float(w[i]) for i in range(d)), F.lit(float(w[-1])))
        off = 1 / (1 + F.exp(-margin)) - F.col("y")
        g = z.agg(*[F.avg(F.col(f"z{i}") * off) for i in range(d)], F.avg(off)).first()
        w = w - rate * (np.array(g[:]) + shrink * np.append(w[:-1], 0) / m.n)
    coef = w[:-1] / sd
    return rows.drop("sieve_train").withColumn("score", 1 / (1 + F.exp(-Linear(coef, float(w[-1] - mu @ coef)).column(F.col(x)))))


def isotonic(train: DataFrame, rows: DataFrame, x: str, y: str, into: str) -> DataFrame:
    """rows with column `into`: the isotonic fit of y over x of the training rows. Equal x are merged by their mean,
    between fitted points is interpolated, beyond the ends the last value holds. Pools are formed in parallel."""
    from pyspark.ml.regression import IsotonicRegression

    fitted = train.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(x).cast("double").alias("features")).agg(F.avg(F.col(y).cast("double")).alias("label"), F.count("*").cast("double").alias("weight"))
    model = IsotonicRegression(weightCol="weight", predictionCol=into).fit(fitted)
    return model.transform(rows.withColumn("features", F.col(x).cast("double"))).drop("features")


def merged(df: DataFrame, x: str, y: str) -> DataFrame:
    """Distinct x with the mean of y and the weight."""
    return df.groupBy(x).agg(F.avg(y).alias(y), F.count("*").alias("weight"))


# Splits.


def group_split(df: DataFrame, group: str, share: float = 0.4, seed: int = 0) -> DataFrame:
    """df with column test: whole groups, round(share x groups) of them (one at least), those first by a hash."""
    groups = df.select(F.col(group).cast("string").alias("sieve_g")).distinct()
    n = F.greatest(F.lit(1), F.bround(groups.agg(F.count("*")).scalar() * share))
    placed = with_position(groups.withColumn("h", stable_hash(F.concat(F.lit(f"{seed}|"), "sieve_g"))), ["h", "sieve_g"], "at")
    chosen = placed.select("sieve_g", (F.col("at") < n).alias("test"))
    return df.withColumn("sieve_g", F.col(group).cast("string")).join(chosen, "sieve_g").drop("sieve_g")


def folds(df: DataFrame, group: str, splits: int = 5, repeats: int = 20, seed: int = 0) -> DataFrame:
    """df once for each repeat, with repeat and fold; the rows of a group share a fold."""
    rows = df.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    return rows.withColumn("fold", (stable_hash(F.concat_ws("|", F.lit(str(seed)), F.col("repeat").cast("string"), F.col(group).cast("string"))) % splits).cast("int"))


def out_of_fold(df: DataFrame, key: str, x: str, y: str, group: str, splits: int = 5, repeats: int = 20, alpha: float = 1.0, seed: int = 0, dims: int | None = None) -> DataFrame:
    """key, y, group, raw, calibrated: predictions of a ridge that has not seen the row's group, averaged over repeats.

    All folds' models come from one pass: a fold's training sums are all sums less its own. Calibration is isotonic
    on the training rows' own predictions, one parallel fit a fold."""
    rows = df.select(F.col(key).alias("key"), F.col(y).cast("double").alias("y"), F.col(group).cast("string").alias("group"), F.slice(F.col(x).cast("array<double>"), 1, dims).alias("x") if dims else F.col(x).cast("array<double>").alias("x"))
    dealt = written(folds(rows, "group", splits, repeats, seed))
    sums = moments(dealt, "x", "y", ["repeat", "fold"])
    total: dict[str, Moments] = {}
    for (r, _), m in sums.items():
        total[r] = total[r] - Moments(-m.n, -m.x, -m.xx, -m.y, -m.xy, -m.yy) if r in total else m
    parts = []
    for (r, f), m in sorted(sums.items()):
        model = ridge(total[r] - m, alpha)
        own = dealt.where((F.col("repeat") == int(r)) & model_rows(total[r], m)).withColumn("raw", model.column(F.col("x")))
        train, test = own.where(F.col("fold") != int(f)), own.where(F.col("fold") == int(f))
        parts.append(isotonic(train, test.select("key", "y", "group", "raw"), "raw", "y", "calibrated"))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy("key").agg(F.first("y").alias("y"), F.first("group").alias("group"), F.avg("raw").alias("raw"), F.avg("calibrated").alias("calibrated"))


def model_rows(total: Moments, own: Moments) -> Column:
    """False where a fold holds all groups, so that nothing is left to learn from."""
    return F.lit(bool(total.n > own.n))


# Bootstrap.


def bootstrap(df: DataFrame, columns: Sequence[str], statistics: dict[str, Callable[..., float]], draws: int = 2000, cluster: str | None = None, seed: int = 0, parts: int = 16) -> DataFrame:
    """draw, name, value: statistics of resampled rows, or of whole resampled clusters. statistic(column, ...) gets arrays.

    Draws are dealt to tasks, each of which holds the columns (their rows are counted first and must be at most
    BOOTSTRAP_ROWS_MOST). A draw depends on seed and its number alone."""
    n = df.count()
    if n > BOOTSTRAP_ROWS_MOST:
        raise ValueError(f"{n} rows; a bootstrap takes {BOOTSTRAP_ROWS_MOST} at most")
    order = [cluster, *columns] if cluster else list(columns)
    table = df.select(*columns, *([F.dense_rank().over(Window.orderBy(cluster)).alias("sieve_c")] if cluster else [])).orderBy(*([("sieve_c")] if cluster else []), *columns).toArrow() if order else None
    held = df.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data = [held.value.column(c).to_numpy() for c in columns]
        size = len(data[0]) if data else 0
        if cluster and size:
            code = held.value.column("sieve_c").to_numpy() - 1
            starts = np.searchsorted(code, np.arange(code.max() + 2))
        for batch in batches:
            rows = []
            for b in batch.column("id").to_pylist() if size else []:
                rng = np.random.default_rng((seed, b))
                if cluster:
                    pick = rng.integers(0, len(starts) - 1, len(starts) - 1)
                    at = np.concatenate([np.arange(starts[c], starts[c + 1]) for c in pick])
                else:
                    at = rng.integers(0, size, size)
                rows += [(b, name, float(f(*(d[at] for d in data)))) for name, f in statistics.items()]
            cols = list(zip(*rows, strict=True)) if rows else [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.float64()), strict=True)], ["draw", "name", "value"])

    return df.sparkSession.range(0, draws, 1, parts).mapInArrow(run, "draw long, name string, value double")


def intervals(draws: DataFrame, alpha: float = 0.05) -> DataFrame:
    """name, low, high: percentile interval of each statistic; NaN and null draws are left out."""
    good = draws.where(F.col("value").isNotNull() & ~F.isnan("value"))
    return good.groupBy("name").agg(F.percentile("value", F.lit(alpha / 2)).alias("low"), F.percentile("value", F.lit(1 - alpha / 2)).alias("high"))


def row_interval(df: DataFrame, columns: Sequence[str], statistic: Callable[..., float], draws: int = 200, seed: int = 0) -> DataFrame:
    """low, high of one statistic over resampled rows; null with fewer than four rows."""
    found = intervals(bootstrap(df, columns, {"s": statistic}, draws, None, seed))
    few = df.count() < 4
    return found.select(*[F.when(F.lit(not few), F.round(c, 4)).alias(c) for c in ("low", "high")])


# Statistics of arrays, as a bootstrap needs them.


def ranks(x: np.ndarray) -> np.ndarray:
    _, inverse, count = np.unique(x, return_inverse=True, return_counts=True)
    return (np.cumsum(count) - (count - 1) / 2)[inverse]


def rho(a: np.ndarray, b: np.ndarray) -> float:
    if len(a) < 2 or a.min() == a.max() or b.min() == b.max():
        return 0.0
    return float(np.corrcoef(ranks(a), ranks(b))[0, 1])


def ranked_auc(y: np.ndarray, s: np.ndarray) -> float:
    p = int((y == 1).sum())
    q = len(y) - p
    return float((ranks(s)[y == 1].sum() - p * (p + 1) / 2) / (p * q)) if p and q else 0.5


def recall_mean(y: np.ndarray, guess: np.ndarray) -> float:
    return float(np.mean([(guess[y == c] == c).mean() for c in np.unique(y)])) if len(y) else 0.0


def two_bucket(cut: float) -> Callable[[np.ndarray, np.ndarray], float]:
    return lambda y, p: recall_mean(y >= cut, p >= cut)


# Tables of results.


def mean_absolute_error(df: DataFrame, y: str, p: str) -> DataFrame:
    return df.agg(F.avg(F.abs(F.col(y) - F.col(p))).alias("mae"))


def two_bucket_accuracy(df: DataFrame, y: str, p: str, cut: float) -> DataFrame:
    """Balanced accuracy of `at least cut`, predicted by predictions of at least cut."""
    from sievework.operators.metrics import balanced_accuracy

    high = df.select((F.col(y) >= cut).alias("truth"), (F.col(p) >= cut).alias("guess"))
    return balanced_accuracy(high, "truth", "guess")


def first_below(levels: DataFrame, value: str, floor: float) -> DataFrame:
    """boundary: the middle of the first pair of adjacent levels (lo, hi) whose value is below the floor; null if none is
    (right-censored)."""
    return levels.where(F.col(value) < floor).agg(F.min_by((F.col("lo") + F.col("hi")) / 2, F.col("lo")).alias("boundary"))
