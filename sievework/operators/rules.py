"""Manifest assertions V1-V12 as violation tables (rule, split, key, n): what is wrong, where, how often."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions.exprs import digitize, is_degraded, json_has, nongen_chain, nuisance_cell, path_suffix
from sievework.operators.order import stored

KINDS, COMPOSITING = ("real", "real_vae_rt", "edited"), ("none", "paste", "paste_feather")
MASKED = ("inpaint", "outpaint", "object_replacement", "background_editing")
RATIO_SPLITS = ("train", "test_a", "test_f")
AREA_EDGES = (0.05, 0.15, 0.35, 0.7)


def _found(rule: str, df: DataFrame, split: Column, key: Column, n: Column) -> DataFrame:
    return df.select(F.lit(rule).alias("rule"), split.cast("string").alias("split"), key.cast("string").alias("key"), n.cast("long").alias("n"))


def _count(rule: str, df: DataFrame, split: Column, key: Column) -> DataFrame:
    rows = df.groupBy(split.cast("string").alias("split"), key.cast("string").alias("key")).agg(F.count("*").alias("n"))
    return _found(rule, rows, F.col("split"), F.col("key"), F.col("n"))


def v1(df: DataFrame) -> DataFrame:
    """Stored format: only .png beside exempt rows."""
    rows = df.where(~F.coalesce(F.col("io_chain") == "legacy", F.lit(False)) & ~is_degraded(F.col("postprocess"))).withColumn("suffix", path_suffix(F.col("image_path")))
    return _count("V1", rows.where("suffix <> '.png'"), F.col("split"), F.col("suffix"))


def v2(df: DataFrame) -> DataFrame:
    """Real and fake rows of a split have the same non-generating chains."""
    rows = df.where(~F.coalesce(F.col("io_chain") == "legacy", F.lit(False))).groupBy("split", nongen_chain(F.col("io_chain")).alias("chain")).agg(F.max(F.col("is_fake") == 0).alias("r"), F.max(F.col("is_fake") == 1).alias("f"), F.count("*").alias("n"))
    both = rows.groupBy(F.col("split").alias("s")).agg(F.max("r").alias("any_r"), F.max("f").alias("any_f")).where("any_r and any_f")
    rows = rows.where("r <> f").join(both, F.col("split").eqNullSafe(F.col("s")))
    return _found("V2", rows, F.col("split"), F.col("chain"), F.col("n"))


def v3(df: DataFrame) -> DataFrame:
    """Domains of sample_kind and compositing; masked operators need compositing."""
    kind, comp, masked = F.col("sample_kind"), F.col("compositing"), F.col("operator").isin(list(MASKED))
    wrong = F.array_compact(F.array(
        F.when(kind.isNotNull() & ~kind.isin(list(KINDS)), F.concat(F.lit("kind:"), kind)), F.when(comp.isNotNull() & ~comp.isin(list(COMPOSITING)), F.concat(F.lit("compositing:"), comp)),
        F.when(masked & comp.isNull(), F.lit("compositing missing")), F.when(masked & (comp == "paste_feather") & F.col("feather_px").isNull(), F.lit("feather_px missing")),
    ))
    return _count("V3", df.select(F.explode(wrong).alias("key")), F.lit(None), F.col("key"))


def v4(df: DataFrame, low: float = 0.05, high: float = 0.35, min_real: int = 10, profile: str = "auto") -> DataFrame:
    """Share of real_vae_rt to real rows in train, test_a and test_f."""
    kind = F.col("sample_kind")
    rows = df.where(F.col("split").isin(list(RATIO_SPLITS))).groupBy("split").agg(F.count_if(kind == "real").alias("real"), F.count_if(kind == "real_vae_rt").alias("rt")).where(F.col("real") >= max(min_real, 1))
    rows = rows.where(~(F.col("rt") / F.col("real")).between(low, high))
    if profile != "run":
        rows = rows.where(df.where(kind == "real_vae_rt").agg(F.count("*")).scalar() > 0)
    return _found("V4", rows, F.col("split"), F.concat_ws("/", F.col("rt").cast("string"), F.col("real").cast("string")), F.col("rt"))


def v5(df: DataFrame) -> DataFrame:
    rows = df.where("io_chain is null or io_chain = 'legacy'")
    return _count("V5", rows, F.lit(None), F.coalesce("io_chain", F.lit("missing")))


def v6(df: DataFrame, key: str = "image_guidance_scale") -> DataFrame:
    """instruct_edit rows: op_params is a JSON object with the key."""
    ok = F.coalesce(F.col("op_params").rlike("^\\s*\\{"), F.lit(False)) & F.try_parse_json("op_params").isNotNull()
    rows = df.where("operator = 'instruct_edit'").withColumn("why", F.when(~ok, "not an object").when(~json_has(F.col("op_params"), key), "key missing"))
    return _count("V6", rows.where("why is not null"), F.lit(None), F.col("why"))


def v7(df: DataFrame) -> DataFrame:
    """Pairs: two rows of the same seed, base, mask and group; then what their group asks for. One aggregation."""
    one = lambda c: F.min(c).eqNullSafe(F.max(c)) & ((F.count(c) == 0) | (F.count(c) == F.count("*")))
    rows = df.where(F.col("probe_group").isin("compositing_pair", "nd_pair")).groupBy("pair_id").agg(
        F.count("*").alias("n"), *[one(c).alias(c) for c in ("seed", "real_image_path", "mask_path", "generator_name", "compositing")],
        F.min("probe_group").alias("g"), F.max("probe_group").alias("h"), F.sort_array(F.collect_set("compositing")).alias("set"),
    )
    two, mixed = F.col("n") == 2, F.col("g") != F.col("h")
    pair = F.col("g") == "compositing_pair"
    wrong = F.array_compact(F.array(
        F.when(~two, "count"), *[F.when(two & ~F.col(c), c) for c in ("seed", "real_image_path", "mask_path")], F.when(two & mixed, "probe_group"),
        F.when(two & ~mixed & pair & (F.col("set") != F.array(F.lit("none"), F.lit("paste_feather"))), "compositing"), F.when(two & ~mixed & pair & ~F.col("generator_name"), "generator_name"),
        F.when(two & ~mixed & ~pair & F.col("generator_name"), "generator_name"), F.when(two & ~mixed & ~pair & ~F.col("compositing"), "compositing"),
    ))
    rows = rows.select("pair_id", "n", F.explode(wrong).alias("why"))
    return _found("V7", rows, F.lit(None), F.concat_ws(":", "pair_id", "why"), F.col("n"))


def v8(df: DataFrame) -> DataFrame:
    """Rows of a base in one split; degraded rows in their mother's (test_a to test_e excepted)."""
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    groups = df.where(~blank("base_id") & blank("postprocess_of")).groupBy("base_id").agg(F.countDistinct(F.coalesce("split", F.lit("∅"))).alias("n")).where("n > 1")
    # Of repeated ids the last row by path is the mother.
    mothers = df.groupBy(F.col("image_id").alias("mother")).agg(F.max_by(F.struct("split"), F.col("image_path")).alias("m"))
    rows = df.where(~blank("postprocess_of")).join(mothers, F.col("postprocess_of") == F.col("mother"))
    bad = ~F.col("split").eqNullSafe(F.col("m.split")) & ~(F.coalesce(F.col("m.split") == "test_a", F.lit(False)) & F.coalesce(F.col("split") == "test_e", F.lit(False)))
    return _found("V8", groups, F.lit(None), F.concat(F.lit("base:"), "base_id"), F.col("n")).unionByName(_count("V8", rows.where(bad), F.col("split"), F.concat(F.lit("mother:"), F.col("m.split"))))


def v9(df: DataFrame, holdout: Sequence[str]) -> DataFrame:
    hold = F.coalesce(F.col("generator_name").isin(list(holdout)), F.lit(False)) | F.coalesce(F.col("generator_family").isin(list(holdout)), F.lit(False))
    return _count("V9", df.where(F.col("split").isin("train", "val") & hold), F.col("split"), F.concat_ws("/", "generator_name", "generator_family"))


def v10(df: DataFrame, operator: str) -> DataFrame:
    return _count("V10", df.where(F.col("split").isin("train", "val") & (F.col("operator") == operator)), F.col("split"), F.col("operator"))


def diffusion_edit() -> Column:
    c = F.col("io_chain")
    return F.coalesce((F.col("is_fake") == 1) & (c != "legacy") & F.contains(c, F.lit("edit:")), F.lit(False)) & ~F.col("generator_family").eqNullSafe("non_diffusion") & ~F.col("generator_name").eqNullSafe("manual-web-edit")


def v11(df: DataFrame, floor: int = 0) -> DataFrame:
    rows = df.where(diffusion_edit()).withColumn("cell", nuisance_cell(F.col("op_params")))
    found = _count("V11", rows.where("cell is null"), F.lit(None), F.lit("not recorded"))
    if floor:
        cells = rows.where("cell is not null").groupBy("split", "cell").agg(F.count("*").alias("n")).where(F.col("n") < floor)
        found = found.unionByName(_found("V11", cells, F.col("split"), F.col("cell"), F.col("n")))
    return found


def v12(df: DataFrame, floor: int = 0, edges: Sequence[float] = AREA_EDGES) -> DataFrame:
    rows = df.where(F.col("operator").isin(list(MASKED)))
    found = _count("V12", rows.where("mask_area_ratio is null"), F.lit(None), F.lit("no ratio"))
    if floor:
        hit = rows.where("mask_area_ratio is not null").groupBy(digitize(F.col("mask_area_ratio"), edges).alias("b")).agg(F.count("*").alias("c"))
        every = df.sparkSession.range(len(edges)).join(hit, F.col("id") == F.col("b"), "left").select(F.col("id"), F.coalesce("c", F.lit(0)).alias("n")).where(F.col("n") < floor)
        found = found.unionByName(_found("V12", every, F.lit(None), F.concat(F.lit("bucket "), F.col("id").cast("string")), F.col("n")))
    return found


def check_all(df: DataFrame, profile: str = "auto", holdout: Sequence[str] = (), testc_operator: str | None = None, cell_floor: int = 0, bucket_floor: int = 0) -> DataFrame:
    run = profile == "run"
    # What the rules look at is made once, and every rule reads it.
    needed = ("image_id", "image_path", "real_image_path", "mask_path", "is_fake", "split", "io_chain", "postprocess", "sample_kind", "operator", "compositing", "feather_px", "op_params", "base_id", "postprocess_of", "generator_name", "generator_family", "mask_area_ratio", "probe_group", "pair_id", "seed")
    df = stored(df.select(*[c for c in needed if c in df.columns]))
    parts = [v1(df), v2(df), v3(df), v4(df, profile=profile), *([v5(df)] if run else []), v6(df), v7(df), *([v8(df)] if run else []), *([v9(df, holdout)] if holdout else [])]
    parts += ([v10(df, testc_operator)] if run and testc_operator else []) + ([v11(df, cell_floor), v12(df, bucket_floor)] if run else [])
    return reduce(DataFrame.unionByName, parts)

