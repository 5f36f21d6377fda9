"""Gates: whether measured features recover what was done to images. Each is one row of metrics and a verdict.

Inputs are tables of measures (sources/images.profiles joined to the manifest): image_id, is_fake, split, operator,
generator_family, strength, origin (what was edited), profile (array), score."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.operators import estimators as E
from sievework.operators import metrics as M

BOUNDARIES = ((0.3, 0.6), (0.35, 0.65), (0.4, 0.7))
TESTS = ("test_a", "test_b", "test_c", "test_d", "test_e")


def level(s: Column, low: float = 0.35, high: float = 0.65) -> Column:
    return F.when(s < low, "low").when(s < high, "mid").otherwise("high")


def value(df: DataFrame, column: str) -> float:
    """The one value of a one-row result; 0 where there is none."""
    row = df.first()
    return float(row[column]) if row is not None and row[column] is not None else 0.0


def separability(df: DataFrame, label: str, score: str) -> float:
    a = value(M.auc(df, label, score), "auc") if not df.isEmpty() else 0.5
    return max(a, 1 - a)


def result(df: DataFrame, verdict: str, **found) -> DataFrame:
    shown = [F.lit(v).cast("double" if isinstance(v, float) else "long").alias(k) if v is None or not isinstance(v, str) else F.lit(v).alias(k) for k, v in found.items()]
    return df.sparkSession.range(1).select(*shown, F.lit(verdict).alias("verdict"))


def detection(df: DataFrame, places: DataFrame | None = None) -> DataFrame:
    """How well the score tells fake from real, and the map inside from outside (places: auc of each image with a mask)."""
    det = separability(df, "is_fake", "score")
    found = places.agg(F.avg(F.greatest("auc", 1 - F.col("auc"))).alias("m"), F.count("*").alias("n")).first() if places is not None else None
    loc, n = (float(found["m"]), int(found["n"])) if found is not None and found["n"] else (0.5, 0)
    return result(df, "PASS" if det >= 0.6 and loc >= 0.6 else "FAIL", detection_auc=round(det, 4), localization_auc=round(loc, 4), n_localization=n)


def cross_generator(df: DataFrame, family: str) -> DataFrame:
    """Detection of one family's fakes against all real images."""
    rows = df.where((F.col("is_fake") == 0) | (F.col("generator_family") == family))
    n = {r["is_fake"]: r["n"] for r in rows.groupBy("is_fake").agg(F.count("*").alias("n")).collect()}  # two rows
    return result(rows, "EVAL-ONLY", family=family, detection_auc=round(separability(rows, "is_fake", "score"), 4), n_pos=int(n.get(1, 0)), n_neg=int(n.get(0, 0)))


def accuracy(df: DataFrame, test: Column, label: str, vector: str = "profile") -> float:
    """Balanced accuracy on test rows of the nearest centroid of the others; 0 where there is nothing to tell apart."""
    rows = df.withColumns({"sieve_test": test, "sieve_label": F.col(label), "sieve_x": F.col(vector)}).select("image_id", "sieve_test", "sieve_label", "sieve_x")
    sides = rows.groupBy("sieve_test").agg(F.count_distinct("sieve_label").alias("n")).collect()  # two rows
    by = {r["sieve_test"]: r["n"] for r in sides}
    if by.get(False, 0) < 2 or not by.get(True):
        return 0.0
    guess = M.nearest_centroid(rows, ~F.col("sieve_test"), "image_id", "sieve_x", "sieve_label")
    return value(M.balanced_accuracy(guess, "label", "guess"), "balanced_accuracy")


def strength(df: DataFrame, draws: int = 200) -> DataFrame:
    """Whether the editing strength can be told: in three buckets, by centroids and by regression, and in order."""
    rows = E.group_split(df, "origin").withColumns({"bucket": level(F.col("strength")), "first": F.slice("profile", 1, 1)})
    n = rows.count()
    if n < 6:
        return result(df, "FAIL", balanced_accuracy=0.0, spearman_rho=0.0, multi_sigma_acc=0.0, single_sigma_acc=0.0, n=n)
    direct = accuracy(rows, F.col("test"), "bucket")
    single = accuracy(rows, F.col("test"), "bucket", "first")
    model = E.least_squares(E.moments(rows.where("not test"), "profile", "strength")[()])
    tests = rows.where("test").withColumn("guess", model.column(F.col("profile")))
    graded = {f"{a:.2f}_{b:.2f}".replace(".", ""): round(value(M.balanced_accuracy(tests.select(level(F.col("strength"), a, b).alias("y"), level(F.col("guess"), a, b).alias("p")), "y", "p"), "balanced_accuracy"), 4) for a, b in BOUNDARIES}
    regressed = value(M.balanced_accuracy(tests.select("bucket", level(F.col("guess")).alias("p")), "bucket", "p"), "balanced_accuracy")
    cut = float(rows.agg(F.median("strength")).first()[0])
    two = value(E.two_bucket_accuracy(tests, "strength", "guess", cut), "balanced_accuracy")
    rho = value(M.spearman(tests, "strength", "guess"), "rho")
    ci = E.row_interval(tests, ["strength", "guess"], E.two_bucket(cut), draws).first()
    multi = max(direct, regressed)
    verdict = "PASS" if multi >= 0.55 and rho >= 0.3 else "WEAK" if multi >= 0.45 else "FAIL"
    return result(df, verdict, balanced_accuracy=round(multi, 4), direct_acc=round(direct, 4), regression_bucket_acc=round(regressed, 4), spearman_rho=round(rho, 4), multi_sigma_acc=round(multi, 4), single_sigma_acc=round(single, 4),
                  two_bucket_acc=round(two, 4), two_bucket_low=ci["low"] if ci else None, two_bucket_high=ci["high"] if ci else None, **{f"acc_{k}": v for k, v in graded.items()}, n=n)


def family_pairs(df: DataFrame) -> DataFrame:
    """seen, unseen: ordered pairs of different families that share at least two operators, with those operators.

    Families and operators are vocabularies: the join is of their distinct combinations."""
    have = df.where("operator is not null and generator_family is not null").select("generator_family", "operator").distinct()
    left, right = have.select(F.col("generator_family").alias("seen"), "operator"), have.select(F.col("generator_family").alias("unseen"), "operator")
    return left.join(right, "operator").where("seen <> unseen").groupBy("seen", "unseen").agg(F.sort_array(F.collect_list("operator")).alias("operators")).where(F.size("operators") >= 2)


def operators(df: DataFrame) -> DataFrame:
    """Whether the operator can be told within a family and across families."""
    rows = E.group_split(df, "origin")
    families = [r[0] for r in df.groupBy("generator_family").agg(F.count_distinct("operator").alias("n")).where("n >= 2 and generator_family is not null").orderBy("generator_family").collect()]  # a vocabulary
    same = [accuracy(rows.where(F.col("generator_family") == f), F.col("test"), "operator") for f in families]
    cross = []
    for r in family_pairs(df).orderBy("seen", "unseen").collect():  # pairs of a vocabulary
        part = df.where(F.col("generator_family").isin(r["seen"], r["unseen"]) & F.col("operator").isin(list(r["operators"])))
        cross.append(accuracy(part, F.col("generator_family") == r["unseen"], "operator"))
    a, b = (sum(x) / len(x) if x else 0.0 for x in (same, cross))
    verdict = "PASS" if a >= 0.5 and b >= 0.4 else "CONFOUND" if a >= 0.5 and b < 0.3 else "WEAK"
    return result(df, verdict, same_model_acc=round(a, 4), cross_model_acc=round(b, 4), n=df.count())


def increments(by_strength: DataFrame, by_operator: DataFrame) -> DataFrame:
    """What several scales add to one, and what is lost on held-out generators."""
    g = strength(by_strength).first()
    delta = round(g["multi_sigma_acc"] - g["single_sigma_acc"], 4)
    seen = E.group_split(by_operator.where("split = 'train'"), "origin")
    known = accuracy(seen, F.col("test"), "operator")
    held = accuracy(by_operator.where("split in ('train', 'test_b')"), F.col("split") == "test_b", "operator")
    n = max(1, by_operator.select("operator").distinct().count())
    return result(by_operator, "PASS" if delta > 0 and held > 1 / n else "PARTIAL", multi_sigma_delta=delta, seen_acc=round(known, 4), heldout_acc=round(held, 4), cross_generator_drop=round(known - held, 4), random_acc=round(1 / n, 4))


def by_test_split(df: DataFrame, tests: Sequence[str] = TESTS) -> DataFrame:
    """split, detection_auc, n_fake, n_neg: a test split's fakes against its own and the training split's real images.

    Training reals are dealt to every test split (a handful), so one aggregation covers all splits."""
    own = df.where(F.col("split").isin(list(tests))).select("split", "is_fake", "score")
    shared = df.where("split = 'train' and is_fake = 0").withColumn("split", F.explode(F.array(*[F.lit(t) for t in tests]))).select("split", "is_fake", "score")
    found = M.auc(own.unionByName(shared), "is_fake", "score", ("split",))
    return found.select("split", F.when((F.col("positives") > 0) & (F.col("negatives") > 0), F.round(M.separability(F.col("auc")), 4)).alias("detection_auc"), F.col("positives").alias("n_fake"), F.col("negatives").alias("n_neg"))


def false_alarms(df: DataFrame) -> DataFrame:
    """fpr, threshold, direction: real images of test_f beyond the training reals' 95 % (or 5 %) bound, on the side where
    training fakes lie."""
    train = df.where("split = 'train'").agg(*[F.expr(f"median(score) filter (where is_fake = {k})").alias(f"m{k}") for k in (0, 1)], *[F.expr(f"percentile(score, {q}) filter (where is_fake = 0)").alias(f"q{int(q * 100)}") for q in (0.05, 0.95)])
    high = F.coalesce(train.select(F.col("m1") >= F.col("m0")).scalar(), F.lit(True))
    bound = F.when(high, train.select("q95").scalar()).otherwise(train.select("q5").scalar())
    tests = df.where("split = 'test_f' and is_fake = 0").select(F.when(high, F.col("score") > bound).otherwise(F.col("score") < bound).cast("double").alias("hit"))
    return tests.agg(F.round(F.avg("hit"), 4).alias("fpr")).select("fpr", bound.alias("threshold"), F.when(high, "high=fake").otherwise("low=fake").alias("direction"))


def evaluate(df: DataFrame, dims: dict[str, int | None], cut: float = 0.4, splits: int = 5, repeats: int = 20, draws: int = 2000, seed: int = 20260715, alpha: float = 1.0) -> DataFrame:
    """configuration, rho, ba2, mae with percentile intervals of whole resampled origins, for nested prefixes of the profile
    that share folds and draws."""
    out = None
    for name, d in dims.items():
        oof = E.written(E.out_of_fold(df, "image_id", "profile", "strength", "origin", splits, repeats, alpha, seed, d))
        stats = {"rho": lambda y, r, c: E.rho(y, r), "ba2": lambda y, r, c: E.two_bucket(cut)(y, c), "mae": lambda y, r, c: float(abs(y - c).mean())}
        ci = E.intervals(E.bootstrap(oof, ["y", "raw", "calibrated"], stats, draws, "group", seed + 1))
        wide = ci.groupBy().pivot("name", list(stats)).agg(F.first("low").alias("low"), F.first("high").alias("high"))
        row = M.spearman(oof, "y", "raw").select(F.round("rho", 4).alias("rho"), "n")
        both = E.two_bucket_accuracy(oof, "y", "calibrated", cut).select(F.round("balanced_accuracy", 4).alias("ba2"))
        mae = E.mean_absolute_error(oof, "y", "calibrated").select(F.round("mae", 4).alias("mae"))
        one = row.select(F.lit(name).alias("configuration"), "n", "rho", both.scalar().alias("ba2"), mae.scalar().alias("mae"), *[F.round(wide.select(c).scalar(), 4).alias(c) for c in wide.columns])
        out = one if out is None else out.unionByName(one)
    return out


def recovery_verdict(rho: float, rho_low: float, ba2: float, ba2_low: float, mae: float, increment_low: float) -> dict[str, bool | str]:
    """What the evaluation allows to be said."""
    primary, aux, fine = rho >= 0.5 and rho_low > 0.3, ba2 >= 0.66 and ba2_low > 0.55, mae <= 0.15
    said = "estimate" if primary and fine else "ordinal recovery" if primary else ("coarse grades" if aux else "ordinal statement") if rho >= 0.3 else "withdrawn"
    return {"primary": primary, "aux": aux, "tier_072": aux and ba2 >= 0.72, "mae_ok": fine, "c4": increment_low > 0, "verdict": said}


def nuisance(oof: DataFrame, cells: DataFrame) -> DataFrame:
    """cell, rho, n: rank correlation within each nuisance cell, in all, and by cfg and by steps alone (oof: key, y, raw;
    cells: key, cfg, steps)."""
    rows = oof.join(cells, "key")
    both = F.concat(F.lit("cfg"), F.col("cfg").cast("string"), F.lit("/st"), F.col("steps").cast("string"))
    marks = F.array(both, F.concat(F.lit("cfg"), F.col("cfg").cast("string")), F.concat(F.lit("st"), F.col("steps").cast("string")), F.lit("all"))
    long = rows.select(F.explode(marks).alias("cell"), "y", "raw")
    ranked = long
    for c in ("y", "raw"):  # average ranks within each cell
        counts = long.groupBy("cell", c).agg(F.count("*").alias("n"))
        placed = M.with_running(counts, ["cell", c], {"upto": "n"})
        first = placed.groupBy("cell").agg(F.min(F.col("upto") - F.col("n")).alias("base"))
        ranked = ranked.join(placed.join(first, "cell").select("cell", c, (F.col("upto") - F.col("base") - F.col("n") / 2.0 + 0.5).alias(f"r_{c}")), ["cell", c])
    rho = F.try_divide(F.covar_pop("r_y", "r_raw"), F.stddev_pop("r_y") * F.stddev_pop("r_raw"))
    return ranked.groupBy("cell").agg(F.round(F.coalesce(rho, F.lit(0.0)), 4).alias("rho"), F.count("*").alias("n"))


def geometry(df: DataFrame, trivial: float = 0.9, rounds: int = 300) -> DataFrame:
    """operator, auc, balanced_accuracy, n_pos, decision: whether a mask's shape alone gives the operator away (df: image_id,
    operator, origin, profile = the mask's geometry)."""
    rows = E.written(E.group_split(df, "origin"))
    out = None
    for op in [r[0] for r in rows.select("operator").where("operator is not null").distinct().orderBy("operator").collect()]:  # a vocabulary
        own = rows.withColumn("y", (F.col("operator") == op).cast("int"))
        sides = own.groupBy("test").agg(F.min("y").alias("a"), F.max("y").alias("b")).collect()  # two rows
        if any(not r["b"] or (not r["test"] and r["a"]) for r in sides) or len(sides) < 2:
            continue
        scored = E.logistic(own, "profile", "y", ~F.col("test"), rounds).where("test")
        auc = M.auc(scored, "y", "score").select(F.lit(op).alias("operator"), F.round("auc", 4).alias("auc"))
        ba = M.balanced_accuracy(scored.select("y", (F.col("score") >= 0.5).cast("int").alias("p")), "y", "p").select(F.round("balanced_accuracy", 4))
        one = auc.select("operator", "auc", ba.scalar().alias("balanced_accuracy"), own.agg(F.sum("y")).scalar().alias("n_pos"), F.when(F.col("auc") >= trivial, "geometry-trivial").otherwise("eligible").alias("decision"))
        out = one if out is None else out.unionByName(one)
    return out if out is not None else df.sparkSession.createDataFrame([], "operator string, auc double, balanced_accuracy double, n_pos long, decision string")
