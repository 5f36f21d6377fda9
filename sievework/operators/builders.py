"""Row generation: which samples a data set is to hold, as relational expansions of base rows.

Each function turns base rows into manifest rows (columns of `MADE`), without pixels: choices are hashes of a
row's own identifiers, so rows do not depend on how a table is partitioned. Plug-ins fill in the pixels later.
Base rows have image_id, image_path, real_image_path, base_id, source_dataset, io_chain, height, width (pixels) and
bi, their place among the bases (operators/order.py gives it)."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.config import Config, Generator, PromptBank
from sievework.functions import exprs as X
from sievework.operators.order import with_position
from sievework.sources.manifest import FIELDS

MADE = tuple(FIELDS)
SEED_GRID, SEED_CELLS = 10_000_000, 100_000
HOLD_EVERY = 5  # one in so many origins is edited by held-out generators

# Fixed values: (level1, level2, level3, mask) of an operator in a probe.
PROBE_OPERATORS = {
    "img2img": ("whole_generated", "diffusion", None, None),
    "inpaint": ("partial_manipulated", "AIGC-editing", "mask_guided_inpainting", "box"),
    "outpaint": ("partial_manipulated", "AIGC-editing", "image_guided_editing", "border"),
    "object_replacement": ("partial_manipulated", "AIGC-editing", "object_replacement", "box"),
    "background_editing": ("partial_manipulated", "AIGC-editing", "image_guided_editing", "invert"),
}
# Manipulation type -> (level3, prompt kind, operator) of a local edit, in their order.
LOCAL_EDITS = {
    "object_insertion": ("mask_guided_inpainting", "object", "inpaint"),
    "object_replacement": ("object_replacement", "object", "object_replacement"),
    "object_removal": ("object_removal", "inpaint", "inpaint"),
    "attribute_editing": ("text_guided_editing", "inpaint", "inpaint"),
    "background_editing": ("image_guided_editing", "background", "background_editing"),
    "text_editing": ("text_editing", "inpaint", "inpaint"),
    "face_editing": ("face_swap", "inpaint", "inpaint"),
}
WEB_EDITS = (("splicing", "image_guided_editing"), ("copy-move", "image_guided_editing"), ("removal", "object_removal"))


def shaped(df: DataFrame, made: Mapping[str, Column | None]) -> DataFrame:
    """Manifest rows: the given columns, null for all others, in the manifest's order."""
    return df.select(*[(made[c] if made.get(c) is not None else F.lit(None)).cast(FIELDS[c]).alias(c) for c in MADE])


def generators(specs: Sequence[Generator]) -> Column:
    return F.array(*[F.struct(F.lit(g.name).alias("name"), F.lit(g.family).alias("family"), F.lit(i).alias("i")) for i, g in enumerate(specs)])


def at(values: Sequence, number: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (number + 1).cast("int"))


def from_hash(values: Sequence, key: Column) -> Column:
    return at(values, X.stable_hash(key) % len(values))


def preset_split(name: Column, holdout: Sequence[str]) -> Column:
    """test_b for held-out generators, else train."""
    return F.when(name.isin(list(holdout)), "test_b").otherwise("train") if holdout else F.lit("train")


def origin() -> Column:
    return F.coalesce(F.nullif("real_image_path", F.lit("")), F.col("image_path"))


def pool_of(specs: Sequence[Generator], holdout: Sequence[str], held: Column, fallback: bool = False) -> Column:
    """The generators that edit a row: held-out ones where `held`, else the others."""
    out = [g for g in specs if g.name in set(holdout)]
    rest = [g for g in specs if g.name not in set(holdout)] or (list(specs) if fallback else [])
    none = generators([Generator("", "")])
    empty = F.slice(none, 1, 0)
    return F.when(held, generators(out) if out else empty).otherwise(generators(rest) if rest else empty)


def number_text(values: Sequence) -> list[str]:
    return [json.dumps(v) for v in values]


def policy(config: Config, bank: PromptBank, kind: str, iid: Column) -> dict[str, Column]:
    """Nuisance parameters and prompt of a row, and their record: JSON with sorted keys."""
    cfg = from_hash(number_text([float(c) for c in config.nuisance_cfg_grid]), F.concat(iid, F.lit("cfg")))
    steps = from_hash(number_text([int(s) for s in config.nuisance_steps_grid]), F.concat(iid, F.lit("st")))
    record = F.concat(F.lit('{"cfg_scale": '), cfg, F.lit(', "prompt": '), bank.pick_json(kind, iid), F.lit(f', "prompt_bank_version": "{bank.version}", "steps": '), steps, F.lit("}"))
    return {"prompt": bank.pick(kind, iid), "op_params": record}


def edited(base: str = "image_id") -> dict[str, Column]:
    return {"real_image_path": F.col("image_path"), "is_fake": F.lit(1), "source_dataset": F.col("source_dataset"), "sample_kind": F.lit("edited"), "base_id": F.col(base)}


def by_generator(g: Column) -> dict[str, Column]:
    return {"manipulation_level4": g["name"], "generator_name": g["name"], "generator_family": g["family"]}


def edit_chain(height: Column, name: Column) -> Column:
    return X.chain(F.lit("decode"), F.concat(F.lit("rs"), height.cast("string")), F.concat(F.lit("edit:"), name), F.lit("png"))


def border_ratio(h: Column, w: Column, share: Column) -> Column:
    """Area ratio of a border mask."""
    b = F.floor(F.least(h, w) * share)
    return F.round(1 - F.greatest(h - 2 * b, F.lit(0)) * F.greatest(w - 2 * b, F.lit(0)) / (h * w), 4)


# Real images.


def real_rows(accepted: DataFrame, resolutions: Sequence[int] = ()) -> DataFrame:
    """One real row per accepted image (content: hex SHA-1, height, source_dataset, license), or one per resolution;
    the smallest resolution's row is the base of its siblings."""
    named = lambda iid: F.concat(F.lit("D0_real_pristine/"), iid, F.lit(".png"))
    fixed = {"is_fake": F.lit(0), "task_type": F.lit("real_pristine"), "source_dataset": F.col("source_dataset"), "license": F.col("license"), "sample_kind": F.lit("real")}
    chain = lambda size: X.chain(F.lit("decode"), F.concat(F.lit("rs"), size.cast("string")), F.lit("png"))
    if not resolutions:
        rows = accepted.withColumn("iid", F.concat(F.lit("real_"), F.substring(F.sha1(F.unhex("content")), 1, 12)))
        return shaped(rows, fixed | {"image_id": F.col("iid"), "image_path": named(F.col("iid")), "base_id": F.col("iid"), "io_chain": chain(F.col("height"))})
    sizes = sorted(resolutions)
    rows = accepted.withColumn("size", F.explode(F.array(*[F.lit(s) for s in sizes])))
    iid = lambda size: X.make_image_id("real", F.concat("content", F.lit("-r"), size.cast("string")))
    rows = rows.withColumns({"iid": iid(F.col("size")), "first": iid(F.lit(sizes[0]))})
    real = F.when(F.col("size") != sizes[0], named(F.col("first")))
    return shaped(rows, fixed | {"image_id": F.col("iid"), "image_path": named(F.col("iid")), "real_image_path": real, "base_id": F.col("first"), "io_chain": chain(F.col("size"))})


def halves(bases: DataFrame, order: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The first and the second half of the bases by position; all of them where a half is empty."""
    placed = with_position(bases, order, "sieve_at")
    n = bases.count()
    cut = [placed.where(F.col("sieve_at") < n // 2), placed.where(F.col("sieve_at") >= n // 2)]
    first, second = (p if size else placed for p, size in zip(cut, (n // 2, n - n // 2), strict=True))
    return first.drop("sieve_at"), second.drop("sieve_at")


# Generated and edited images.


def whole_rows(df: DataFrame, specs: Sequence[Generator], prompts: Sequence[str], per_generator: int, seed: int = 0, size: int = 256) -> DataFrame:
    """generators x per_generator wholly generated rows. df: any table of the session."""
    level2 = {"diffusion": "diffusion", "GAN": "GAN", "autoregressive": "autoregressive"}
    rows = df.sparkSession.range(per_generator).withColumn("g", F.explode(generators(specs)))
    rows = rows.withColumns({"sd": F.col("g.i") * 1000 + F.col("id") + seed, "p": at(prompts, (F.col("g.i") + F.col("id")) % len(prompts))})
    rows = rows.withColumn("iid", X.make_image_id("whole_gen", F.concat_ws("-", "g.name", F.col("sd").cast("string"), "p")))
    g = F.col("g")
    return shaped(rows, by_generator(g) | {
        "image_id": F.col("iid"), "image_path": F.concat(F.lit("D1_whole_generated/"), "iid", F.lit(".png")), "is_fake": F.lit(1), "task_type": F.lit("whole_image_detection"), "manipulation_level1": F.lit("whole_generated"),
        "manipulation_level2": X.lookup(g["family"], level2, "diffusion"), "prompt": F.col("p"), "seed": F.col("sd"), "sample_kind": F.lit("edited"), "base_id": F.col("iid"), "io_chain": X.chain(F.concat(F.lit("gen:"), g["name"]), F.lit(f"rs{size}"), F.lit("png")),
    })


def grid_img2img(bases: DataFrame, specs: Sequence[Generator], config: Config, bank: PromptBank, holdout: Sequence[str] = (), any_held: bool | None = None, siblings: DataFrame | None = None) -> DataFrame:
    """Every base by every img2img generator of its pool. A generator of a resolution group edits the base's sibling of
    that resolution (siblings: base_id, io_chain), where there is one."""
    any_held = any(g.name in set(holdout) for g in specs) if any_held is None else any_held
    held = F.lit(any_held) & (X.stable_hash(origin()) % HOLD_EVERY == 0)
    rows = bases.withColumn("g", F.explode(pool_of(specs, holdout, held)))
    size = {n: str(r) for r, names in config.resolution_groups.items() for n in names}
    rows = rows.withColumn("wanted", X.lookup(F.col("g.name"), size).cast("int") if size else F.lit(None).cast("int"))
    if siblings is not None and size:
        there = siblings.select(F.col("base_id").alias("of"), X.chain_resolution(F.col("io_chain")).alias("res")).where("of is not null and res is not null").distinct()
        rows = rows.join(there, (F.coalesce("base_id", "image_id") == F.col("of")) & (F.col("wanted") == F.col("res")), "left")
        rows = rows.withColumn("gen_h", F.coalesce("res", "height"))
    else:
        rows = rows.withColumn("gen_h", F.col("height"))
    name = F.col("g.name")
    rows = rows.withColumn("iid", X.make_image_id("grid_i2i", F.concat_ws("-", "image_id", name)))
    iid, (low, high) = F.col("iid"), config.strength_range
    rows = rows.withColumn("strength_", X.hash_strength(F.concat(iid, F.lit("s")), low, high))
    return shaped(rows, edited() | by_generator(F.col("g")) | policy(config, bank, "img2img", iid) | {
        "image_id": iid, "image_path": F.concat(F.lit("Grid_ops/"), iid, F.lit(".png")), "task_type": F.lit("whole_image_detection"), "manipulation_level1": F.lit("whole_generated"), "manipulation_level2": F.lit("diffusion"),
        "operator": F.lit("img2img"), "strength": F.col("strength_"), "init_timestep": X.init_timestep(F.col("strength_")), "seed": F.col("bi") * 1000 + X.stable_hash(name) % 500 + (config.seed + SEED_GRID),
        "split": preset_split(name, holdout), "compositing": F.lit("none"), "io_chain": edit_chain(F.col("gen_h"), name),
    })


def compositing_of(iid: Column, feather: int) -> dict[str, Column]:
    feathered = X.stable_hash(F.concat(iid, F.lit("comp"))) % 2 == 1
    return {"compositing": F.when(feathered, "paste_feather").otherwise("none"), "feather_px": F.when(feathered, feather)}


def grid_outpaint(bases: DataFrame, specs: Sequence[Generator], config: Config, bank: PromptBank, holdout: Sequence[str] = (), any_held: bool | None = None) -> DataFrame:
    """One outpainted row of every base whose pool has an inpainter, dealt in turn."""
    any_held = any(g.name in set(holdout) for g in specs) if any_held is None else any_held
    held = F.lit(any_held) & (X.stable_hash(origin()) % HOLD_EVERY == 0)
    rows = bases.withColumn("pool", pool_of(specs, holdout, held)).where(F.size("pool") > 0)
    rows = rows.withColumn("g", F.get("pool", (F.col("bi") % F.size("pool")).cast("int")))
    name = F.col("g.name")
    rows = rows.withColumn("iid", X.make_image_id("grid_outpaint", F.concat_ws("-", "image_id", name)))
    iid = F.col("iid")
    share = from_hash([float(f) for f in config.outpaint_border_fracs], F.concat("image_id", F.lit("bf")))
    return shaped(rows, edited() | by_generator(F.col("g")) | policy(config, bank, "background", iid) | compositing_of(iid, config.compositing_feather_px) | {
        "image_id": iid, "image_path": F.concat(F.lit("Grid_ops/"), iid, F.lit(".png")), "mask_path": F.concat(F.lit("Grid_ops/masks/"), iid, F.lit(".png")), "task_type": F.lit("localization"),
        "manipulation_level1": F.lit("partial_manipulated"), "manipulation_level2": F.lit("AIGC-editing"), "manipulation_level3": F.lit("image_guided_editing"), "operator": F.lit("outpaint"), "mask_source": F.lit("border"),
        "mask_area_ratio": border_ratio(F.col("height"), F.col("width"), share), "seed": F.col("bi") * 1000 + X.stable_hash(F.concat(F.lit("outpaint-"), name)) % 500 + (config.seed + SEED_GRID),
        "split": preset_split(name, holdout), "io_chain": edit_chain(F.col("height"), name),
    })


def grid(bases: DataFrame, img2img: Sequence[Generator], inpainters: Sequence[Generator], config: Config, bank: PromptBank, holdout: Sequence[str] = (), siblings: DataFrame | None = None) -> DataFrame:
    held = any(g.name in set(holdout) for g in (*img2img, *inpainters))
    return grid_img2img(bases, img2img, config, bank, holdout, held, siblings).unionByName(grid_outpaint(bases, inpainters, config, bank, holdout, held))


def bucketed(candidates: Column, edges: Sequence[float], salt: Column) -> Column:
    """The mask (struct with ratio) that a salt picks: the first of its area bucket, or of the next that has any; the
    first of all if no bucket has. Buckets are those below the last edge and the edges' own."""
    n = len(edges)
    first = X.stable_hash(F.concat(salt, F.lit("bkt"))) % n
    of = lambda b: F.get(F.filter(candidates, lambda c: X.digitize(c["ratio"], edges) == b), 0)
    return F.coalesce(*[of((first + k) % n) for k in range(n)], F.get(candidates, 0))


def local_rows(bases: DataFrame, attempts: DataFrame, n: int, specs: Sequence[Generator], config: Config, bank: PromptBank, holdout: Sequence[str] = ()) -> DataFrame:
    """n local edits. attempts: attempt (from 1), ratio of the mask that was tried (null if none passed the checks).

    Attempt k is of base (k - 1) mod bases; the accepted ones, numbered in order, take manipulation types and
    inpainters in turn."""
    many = bases.agg(F.count(F.lit(1))).scalar()
    tried = attempts.withColumn("of", (F.col("attempt") - 1) % many).join(bases, F.col("of") == F.col("bi"))
    valid = X.area_validity(F.col("ratio"))
    score = X.qes_score([F.lit(0.9), F.lit(0.8), F.when(F.col("ratio").between(0.01, 0.5), 1.0).otherwise(0.5), F.lit(0.8), valid])
    tried = tried.withColumn("score", score).where((valid == 1) & (X.route_from_score(F.col("score")) != "reject"))
    rows = with_position(tried, ["attempt"], "k").where(F.col("k") < n)
    kinds = list(LOCAL_EDITS)
    held = F.lit(any(g.name in set(holdout) for g in specs)) & (X.stable_hash(origin()) % HOLD_EVERY == 0)
    rows = rows.withColumns({"pool": pool_of(specs, holdout, held, True), "kind": at(kinds, F.col("k") % len(kinds)), "sd": F.col("attempt") + config.seed})
    rows = rows.withColumn("g", F.get("pool", (F.col("k") % F.size("pool")).cast("int")))
    rows = rows.withColumn("iid", X.make_image_id("local_edit", F.concat_ws("-", "image_id", "kind", F.col("sd").cast("string"))))
    iid, kind = F.col("iid"), F.col("kind")
    policies = {k: policy(config, bank, k, iid) for k in sorted({v[1] for v in LOCAL_EDITS.values()})}
    of = X.lookup(kind, {k: v[1] for k, v in LOCAL_EDITS.items()})
    choose = lambda c: F.coalesce(*[F.when(of == k, p[c]) for k, p in policies.items()])
    return shaped(rows, edited() | by_generator(F.col("g")) | compositing_of(iid, config.compositing_feather_px) | {
        "image_id": iid, "image_path": F.concat(F.lit("D2_local_aigc_edit/"), iid, F.lit(".png")), "mask_path": F.concat(F.lit("D2_local_aigc_edit/masks/"), iid, F.lit(".png")), "task_type": F.lit("localization"),
        "manipulation_level1": F.lit("partial_manipulated"), "manipulation_level2": F.lit("AIGC-editing"), "manipulation_level3": X.lookup(kind, {k: v[0] for k, v in LOCAL_EDITS.items()}),
        "mask_source": F.lit("SAM"), "mask_area_ratio": F.round("ratio", 4), "prompt": choose("prompt"), "op_params": choose("op_params"), "seed": F.col("sd"), "quality_score": F.round("score", 4), "quality_bucket": X.bucket_from_score(F.col("score")),
        "operator": X.lookup(kind, {k: v[2] for k, v in LOCAL_EDITS.items()}), "io_chain": edit_chain(F.col("height"), F.col("g.name")),
    })


def web_rows(bases: DataFrame, attempts: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n pairs of a base and a manual edit. attempts: attempt, and ratio, confidence, sharpness of the mask found."""
    many = bases.agg(F.count(F.lit(1))).scalar()
    tried = attempts.withColumn("of", (F.col("attempt") - 1) % many).join(bases, F.col("of") == F.col("bi"))
    valid = X.area_validity(F.col("ratio"))
    score = X.qes_score([F.least("confidence", F.lit(1.0)), F.col("sharpness"), F.when(F.col("ratio").between(0.01, 0.5), 1.0).otherwise(0.5), F.lit(0.8), valid])
    tried = tried.withColumn("score", score).where((valid == 1) & (X.route_from_score(F.col("score")) != "reject"))
    rows = with_position(tried, ["attempt"], "k").where(F.col("k") < n).withColumn("iid", X.make_image_id("web_forgery", F.concat_ws("-", "image_id", F.col("attempt").cast("string"))))
    iid, turn = F.col("iid"), F.col("k") % len(WEB_EDITS)
    return shaped(rows, edited() | {
        "image_id": iid, "image_path": F.concat(F.lit("D3_web_human_forgery/"), iid, F.lit(".png")), "mask_path": F.concat(F.lit("D3_web_human_forgery/masks/"), iid, F.lit(".png")), "task_type": F.lit("localization"),
        "manipulation_level1": F.lit("partial_manipulated"), "manipulation_level2": at([a for a, _ in WEB_EDITS], turn), "manipulation_level3": at([b for _, b in WEB_EDITS], turn), "manipulation_level4": F.lit("manual-web-edit"),
        "generator_name": F.lit("manual-web-edit"), "generator_family": F.lit("manual"), "mask_source": F.lit("diff"), "mask_area_ratio": F.round("ratio", 4), "seed": F.col("attempt") + seed, "quality_score": F.round("score", 4),
        "quality_bucket": X.bucket_from_score(F.col("score")), "compositing": F.lit("none"), "io_chain": edit_chain(F.col("height"), F.lit("manual-web-edit")),
    })


def explained_rows(rows: DataFrame, n: int, order: Sequence[str] = ("image_id",)) -> DataFrame:
    """An explainable row for each of the first n rows that have a mask."""
    first = rows.where(F.coalesce("mask_path", F.lit("")) != "").orderBy(*order).limit(n)
    return first.withColumns({"image_id": X.make_image_id("explain", F.col("image_id")), "task_type": F.lit("explainable")}).select(*MADE)


# Probes.


def probe_strength(bases: DataFrame, specs: Sequence[Generator], strengths: Sequence[float], seed: int = 0, holdout: Sequence[str] = (), cfg: Sequence[float] = (), steps: Sequence[int] = ()) -> DataFrame:
    """bases x strengths x cfg x steps, by the base's generator."""
    cells = []
    for s in strengths:
        for c in cfg or [None]:
            for t in steps or [None]:
                op = ({} if c is None else {"cfg_scale": float(c)}) | ({} if t is None else {"steps": int(t)})
                mark = ("" if c is None else f"-c{c:g}") + ("" if t is None else f"-st{t}")
                cells.append((float(s), f"{s}{mark}", f"{c}-{t}" if op else None, json.dumps(op, sort_keys=True) if op else None))
    cell = F.explode(F.array(*[F.struct(F.lit(s).alias("s"), F.lit(k).alias("key"), F.lit(h).alias("salt"), F.lit(o).alias("op")) for s, k, h, o in cells]))
    rows = bases.withColumn("c", cell).withColumn("g", F.element_at(generators(specs), (F.col("bi") % len(specs) + 1).cast("int")))
    name, c = F.col("g.name"), F.col("c")
    sd = F.col("bi") * 1000 + F.bround(c["s"] * 100).cast("long") + seed
    rows = rows.withColumns({"iid": X.make_image_id("probe_s", F.concat_ws("-", "image_id", name, c["key"])), "sd": F.when(c["salt"].isNull(), sd).otherwise(sd + SEED_CELLS + X.stable_hash(c["salt"]) % 99991)})
    return shaped(rows, edited() | by_generator(F.col("g")) | {
        "image_id": F.col("iid"), "image_path": F.concat(F.lit("probe/gate1_strength/"), "iid", F.lit(".png")), "task_type": F.lit("whole_image_detection"), "manipulation_level1": F.lit("whole_generated"), "manipulation_level2": F.lit("diffusion"),
        "operator": F.lit("img2img"), "op_params": c["op"], "strength": c["s"], "init_timestep": X.init_timestep(c["s"]), "seed": F.col("sd"), "split": preset_split(name, holdout), "io_chain": edit_chain(F.col("height"), name),
    })


def probe_operator(bases: DataFrame, img2img: Sequence[Generator], inpainters: Sequence[Generator], operators: Sequence[str], seed: int = 0, holdout: Sequence[str] = (), strength: float = 0.6) -> DataFrame:
    """bases x operators x generators; an operator's generators are the img2img ones or the inpainters."""
    cells = [(op, *PROBE_OPERATORS[op][:3], g) for op in operators for g in (img2img if op == "img2img" else inpainters)]
    cell = F.explode(F.array(*[F.struct(F.lit(o).alias("op"), F.lit(a).alias("l1"), F.lit(b).alias("l2"), F.lit(d).cast("string").alias("l3"), F.lit(g.name).alias("name"), F.lit(g.family).alias("family")) for o, a, b, d, g in cells]))
    rows = bases.withColumn("c", cell)
    c, whole = F.col("c"), F.col("c.op") == "img2img"
    rows = rows.withColumn("iid", X.make_image_id("probe_op", F.concat_ws("-", "image_id", c["op"], c["name"])))
    iid, partial = F.col("iid"), lambda v: F.when(~whole, v)
    return shaped(rows, edited() | by_generator(c) | {
        "image_id": iid, "image_path": F.concat(F.lit("probe/gate2_operator/"), iid, F.lit(".png")), "mask_path": partial(F.concat(F.lit("probe/gate2_operator/masks/"), iid, F.lit(".png"))),
        "task_type": F.when(whole, "whole_image_detection").otherwise("localization"), "manipulation_level1": c["l1"], "manipulation_level2": c["l2"], "manipulation_level3": c["l3"], "operator": c["op"],
        "strength": F.when(whole, F.lit(strength)), "init_timestep": F.when(whole, X.init_timestep(F.lit(strength))), "mask_source": partial(F.lit("probe")), "compositing": partial(F.lit("none")),
        "seed": F.col("bi") * 1000 + X.stable_hash(F.concat_ws("-", c["op"], c["name"])) % 500 + seed, "split": preset_split(c["name"], holdout), "io_chain": edit_chain(F.col("height"), c["name"]),
    })


def compositing_pairs(bases: DataFrame, specs: Sequence[Generator], n_pairs: int, seed: int = 0, feather: int = 8) -> DataFrame:
    """n_pairs pairs of one edit stored as made and blended in; bases and inpainters are dealt in turn."""
    many = bases.agg(F.count(F.lit(1))).scalar()
    pairs = bases.sparkSession.range(n_pairs).withColumn("of", F.col("id") % many).join(bases, F.col("of") == F.col("bi"))
    pairs = pairs.withColumns({"g": F.element_at(generators(specs), (F.col("id") % len(specs) + 1).cast("int")), "pid": F.concat(F.lit("cp"), F.lpad(F.col("id").cast("string"), F.greatest(F.lit(4), F.length(F.col("id").cast("string"))), F.lit("0")))})
    rows = pairs.withColumn("mode", F.explode(F.array(F.lit("none"), F.lit("paste_feather"))))
    rows = rows.withColumn("iid", X.make_image_id("probe_cp", F.concat_ws("-", "pid", "mode")))
    iid = F.col("iid")
    return shaped(rows, edited() | by_generator(F.col("g")) | {
        "image_id": iid, "image_path": F.concat(F.lit("probe/compositing_pairs/"), iid, F.lit(".png")), "mask_path": F.concat(F.lit("probe/compositing_pairs/masks/"), "pid", F.lit(".png")), "task_type": F.lit("localization"),
        "manipulation_level1": F.lit("partial_manipulated"), "manipulation_level2": F.lit("AIGC-editing"), "manipulation_level3": F.lit("mask_guided_inpainting"), "operator": F.lit("inpaint"), "mask_source": F.lit("probe"),
        "seed": F.col("id") + seed, "compositing": F.col("mode"), "feather_px": F.when(F.col("mode") == "paste_feather", feather), "probe_group": F.lit("compositing_pair"), "pair_id": F.col("pid"), "io_chain": edit_chain(F.col("height"), F.col("g.name")),
    })


# Rows made of finished rows.


def copied(df: DataFrame, **changes: Column) -> DataFrame:
    """Rows as they are but for the named columns; the columns stay in their order."""
    return df.select(*[changes.get(c, F.col(f"`{c}`")).alias(c) for c in df.columns])


def degraded_rows(df: DataFrame, share: float, seed: int = 0) -> DataFrame:
    """A degraded row of about that share of the fake rows, chosen by a hash of seed and image_id, as is how.

    The choice is made of hashes where a random generator would ask for a task's state; its kinds and settings are
    those of functions/pixels.degrade."""
    from sievework.functions.pixels import BLUR_KERNELS, JPEG_QUALITIES, NOISE_SIGMAS, RESIZE_SCALES

    key = lambda salt: F.concat(F.lit(f"{seed}|{salt}|"), F.col("image_id"))
    kind = X.stable_hash(key("kind")) % 4
    none = F.lit("none")
    setting = lambda i, values: F.when(kind == i, from_hash(values, key("setting"))).otherwise(none)
    how = F.struct(
        setting(0, [str(q) for q in JPEG_QUALITIES]).alias("jpeg_quality"), setting(1, [str(s) for s in RESIZE_SCALES]).alias("resize"),
        setting(2, [f"k{k}" for k in BLUR_KERNELS]).alias("blur"), setting(3, [f"sigma{s}" for s in NOISE_SIGMAS]).alias("noise"),
    )
    rows = df.where((F.col("is_fake") == 1) & (X.stable_hash(key("take")) / F.lit(4294967296.0) < share))
    return copied(rows, image_id=F.concat("image_id", F.lit("__deg")), image_path=X.with_stem_suffix(F.col("image_path"), "__deg"), postprocess=how, postprocess_of=F.col("image_id"))


def roundtrip_rows(df: DataFrame, share: float, name: str = "mock") -> DataFrame:
    """Real rows of train, test_a and test_f that get a round-trip sibling, by a hash of image_id."""
    rows = df.where((F.col("sample_kind") == "real") & F.col("split").isin("train", "test_a", "test_f") & X.hash_bernoulli(F.concat("image_id", F.lit("vaert")), share))
    path = F.concat(F.regexp_replace("image_path", "(?<=[^/])\\.[^./]*$", ""), F.lit("__vaert.png"))
    changes = {"image_id": F.concat("image_id", F.lit("__vaert")), "image_path": path, "sample_kind": F.lit("real_vae_rt"), "real_image_path": F.col("image_path"), "base_id": X.or_else(F.col("base_id"), F.col("image_id"))}
    return copied(rows, **changes, io_chain=X.roundtrip_chain(F.col("io_chain"), name))


def base_resolution_only(df: DataFrame, splits: Sequence[str], resolution: int) -> DataFrame:
    """df without rows of another resolution in the listed splits; rows of unknown resolution stay."""
    res = X.chain_resolution(F.col("io_chain"))
    return df.where(~F.coalesce(F.col("split").isin(list(splits)), F.lit(False)) | res.isNull() | (res == resolution)) if splits else df


def backfilled(df: DataFrame) -> DataFrame:
    """Rows of older manifests with sample_kind, io_chain, compositing and base_id filled in.

    The base of an edited row is the real row whose image it was made of (of several, the one with the largest
    image_id), else that image's path, else the row itself."""
    real = df.where("is_fake = 0 and image_path is not null").groupBy(F.col("image_path").alias("of")).agg(F.max("image_id").alias("real_id"))
    rows = df.join(real, F.col("real_image_path") == F.col("of"), "left")
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    own = F.when(blank("real_image_path") & (F.col("is_fake") == 0), F.col("image_id")).otherwise(X.or_else(F.coalesce("real_id", "real_image_path"), F.col("image_id")))
    return copied(
        rows.drop("of"),
        sample_kind=X.or_else(F.col("sample_kind"), F.when(F.col("is_fake") != 0, "edited").otherwise("real")),
        io_chain=X.or_else(F.col("io_chain"), F.lit("legacy")),
        compositing=F.when((F.col("is_fake") != 0) & ~blank("mask_path") & F.col("compositing").isNull(), "none").otherwise(F.col("compositing")),
        base_id=X.or_else(F.col("base_id"), own),
    ).drop("real_id")
