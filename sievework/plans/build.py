"""Building a data set: real images in, manifest rows and pixels out, as tables throughout.

Rows come from operators/builders.py; each then meets its base image in a join, and a task calls the plug-in that
makes its pixels. Files and manifest are written under the output folder."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework import backends, reports
from sievework import config as C
from sievework.functions import pixels as P
from sievework.functions.exprs import chain_resolution
from sievework.operators import builders as B
from sievework.operators import gates, near_images
from sievework.operators.order import with_position, written
from sievework.operators.split import assign_splits, check_leakage
from sievework.sources import images, manifest

PROMPTS = ("A quiet harbour in the morning.", "A market street after rain.", "A red bicycle against a brick wall.", "A portrait in window light.", "A mountain lake with reflections.")


def accepted_images(spark: SparkSession, source: DataFrame, n: int) -> DataFrame:
    """ordinal, content, height, width, source_dataset, license, data of the first n images that pass and are no near copies."""
    size = images.measured(source, lambda img: {"problems": P.check_image(img if img.ndim == 3 else None), "height": img.shape[0], "width": img.shape[1]}, "problems array<string>, height int, width int", keep=("ordinal",), drop_unreadable=True)
    good = size.where("size(problems) = 0").join(images.hashes(source, ("ordinal",)), "ordinal")
    kept = near_images.greedy(written(good), "ordinal").where("accepted")
    first = kept.orderBy("ordinal").limit(n)
    return written(first.select("ordinal", "content", "height", "width").join(source, "ordinal"))


def made(rows: DataFrame, files: DataFrame, make: Callable[[dict, np.ndarray | None], dict[str, np.ndarray]], base: str = "real_image_path") -> DataFrame:
    """name, data of what make(row, base image) returns by path, for every row."""
    joined = images.with_pixels(rows, files, base, "sieve_base") if base else rows.withColumn("sieve_base", F.lit(None).cast("binary"))
    wanted = [c for c in ("image_id", "image_path", "mask_path", "generator_name", "generator_family", "operator", "prompt", "strength", "seed", "compositing", "feather_px", "op_params", "mask_source") if c in rows.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                img = P.decode_png(row.pop("sieve_base") or b"")
                out = make(row, None if img is None else P.as_rgb(img))
                yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.string()), pa.array([P.encode_png(x) for x in out.values()], pa.binary())], ["name", "data"])

    return joined.select(*wanted, "sieve_base").mapInArrow(run, "name string, data binary")


def edit(backend: str) -> Callable[[dict, np.ndarray | None], dict[str, np.ndarray]]:
    """Pixels of an edited row: by its operator, from its base."""

    def make(row: dict, img: np.ndarray | None) -> dict[str, np.ndarray]:
        if img is None:
            return {}
        name, family, seed = row["generator_name"], row["generator_family"], {"seed": row["seed"] or 0}
        if row["operator"] == "img2img":
            return {row["image_path"]: backends.get("img2img", backend, name=name, family=family).img2img(img, row["prompt"] or "", row["strength"] or 0.6, seed)[0]}
        h, w = img.shape[:2]
        rng = np.random.default_rng((row["seed"] or 0) & 0x7FFFFFFF)
        mask = P.border_mask(h, w) if row["operator"] == "outpaint" else P.invert(P.box_mask(h, w, rng, 0.3)) if row["operator"] == "background_editing" else P.box_mask(h, w, rng)
        painted = backends.get("inpainter", backend, name=name, family=family).inpaint(img, mask, row["prompt"] or row["operator"] or "", seed)[0]
        final = P.composite(img, painted, P.on(mask).astype(np.float64), row["compositing"] or "none", row["feather_px"] or 8)
        return {row["image_path"]: final, row["mask_path"]: mask}

    return make


def stored(rows: DataFrame, pictures: DataFrame, out: str) -> DataFrame:
    """Writes the pictures; returns name, data of all files in the folder."""
    images.write_images(pictures, out).agg(F.count("*")).collect()
    return images.scan(rows.sparkSession, out)


def real_base(spark: SparkSession, out: str, n: int, seed: int, resolutions: Sequence[int] = ()) -> DataFrame:
    """The real rows, with their files written."""
    pool = accepted_images(spark, written(images.synthetic(spark, n * 3, seed)), n)
    rows = written(B.real_rows(pool, resolutions))
    by_id = pool.withColumn("size", F.explode(F.array(*[F.lit(s) for s in sorted(resolutions)]) if resolutions else F.array(F.col("height"))))
    iid = F.concat(F.lit("real_"), F.substring(F.sha1(F.concat("content", F.lit("-r"), F.col("size").cast("string")).cast("binary")), 1, 12)) if resolutions else F.concat(F.lit("real_"), F.substring(F.sha1(F.unhex("content")), 1, 12))
    pictures = by_id.select(F.concat(F.lit("D0_real_pristine/"), iid, F.lit(".png")).alias("image_path"), "size", "data")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [P.encode_png(P.resize_square(P.decode_png(d), s)) if resolutions else d for d, s in zip(batch.column("data").to_pylist(), batch.column("size").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("image_path"), pa.array(data, pa.binary())], ["name", "data"])

    stored(rows, pictures.mapInArrow(run, "name string, data binary"), out)
    return rows


def as_bases(rows: DataFrame) -> DataFrame:
    """Base rows with their place and size."""
    res = F.coalesce(chain_resolution(F.col("io_chain")), F.lit(256))
    return with_position(rows.withColumns({"height": res, "width": res}), ["image_id"], "bi")


def build(spark: SparkSession, config: C.Config) -> dict:
    """The whole data set under config.out_dir; returns its statistics."""
    out, on = config.out_dir, config.stages
    split_rules = C.read_yaml(config.split_config) if os.path.exists(config.split_config) else {}
    holdout = tuple(split_rules.get("holdout_generators") or ())
    resolutions = sorted(config.resolution_groups)
    bank = C.load_bank(config.prompt_bank)
    real = real_base(spark, out, config.scales["d0"], config.seed, resolutions)
    base = real.where(chain_resolution(F.col("io_chain")) == resolutions[0]) if resolutions else real
    first, second = B.halves(base, ["image_id"])
    parts = [real]
    files = images.scan(spark, out)
    pictures = []
    if on.get("d1") and config.generators:
        whole = written(B.whole_rows(real, config.generators, PROMPTS, config.scales["d1_per_generator"], config.seed))
        backend = config.backend
        pictures.append(made(whole, files, lambda r, _: {r["image_path"]: backends.get("whole_generator", backend, name=r["generator_name"], family=r["generator_family"]).generate(r["prompt"], {"seed": r["seed"]})[0]}, base=""))
        parts.append(whole)
    edits = []
    if on.get("d2") and config.inpainters:
        n = config.scales["d2"]
        attempts = spark.range(1, max(8, n * 8) + 1).select(F.col("id").alias("attempt"), F.lit(0.2).alias("ratio"))
        edits.append(B.local_rows(as_bases(first), attempts, n, config.inpainters, config, bank, holdout))
    if on.get("grid") and config.grid_per_op:
        bases = as_bases(second).where(F.col("bi") < config.grid_per_op)
        edits.append(B.grid(bases, config.img2img, config.inpainters, config, bank, holdout, real if resolutions else None))
    for rows in edits:
        rows = written(rows)
        pictures.append(made(rows, files, edit(config.backend)))
        parts.append(rows)
    if on.get("d4"):
        sources = manifest.union_all([p for p in parts if p is not real])
        parts.append(B.explained_rows(sources, config.scales["d4"]))
    for p in pictures:
        images.write_images(p, out).agg(F.count("*")).collect()
    rows = manifest.union_all(parts)
    if on.get("postprocess"):
        worn = written(B.degraded_rows(rows, config.postprocess_prob, config.seed))
        write_degraded(worn, rows, out)
        rows = rows.unionByName(worn)
    if on.get("split"):
        rows = written(assign_splits(rows, holdout, split_rules.get("holdout_manipulation") or (), split_rules.get("holdout_domains") or ("Places",), config.seed))
        refuse_leaks(rows)
        if resolutions:
            rows = B.base_resolution_only(rows, split_rules.get("base_resolution_only_splits") or (), resolutions[0])
        if config.vae_rt_frac > 0:
            trips = written(B.roundtrip_rows(rows, config.vae_rt_frac))
            backend = config.backend
            images.write_images(made(trips, images.scan(spark, out), lambda r, img: {} if img is None else {r["image_path"]: backends.get("vae_rt", backend).roundtrip(img)}), out).agg(F.count("*")).collect()
            rows = rows.unionByName(trips)
            refuse_leaks(rows)
    rows = written(rows)
    manifest.write_jsonl(rows, os.path.join(out, "manifest.jsonl"))
    found = reports.statistics(rows)
    reports.write_json(found, os.path.join(out, "stats.json"))
    return found


def degraded_pixels(row: dict, img: np.ndarray | None) -> dict[str, np.ndarray]:
    how = row.get("postprocess") or {}
    if img is None:
        return {}
    if how.get("jpeg_quality", "none") != "none":
        img = P.jpeg(img, int(how["jpeg_quality"]))
    if how.get("resize", "none") != "none":
        img = P.rescale(img, float(how["resize"]))
    if how.get("blur", "none") != "none":
        img = P.blur(img, int(how["blur"][1:]))
    if how.get("noise", "none") != "none":
        img = P.noise(img, int(how["noise"][5:]), backends.number(row["image_path"]))
    return {row["image_path"]: img}


def write_degraded(worn: DataFrame, rows: DataFrame, out: str) -> None:
    """Pixels of degraded rows, made from their mothers' files."""
    mothers = rows.select(F.col("image_id").alias("postprocess_of"), F.col("image_path").alias("mother_path"))
    joined = images.with_pixels(worn.join(mothers, "postprocess_of"), images.scan(rows.sparkSession, out), "mother_path", "data").select("image_path", "postprocess", "data")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                img = P.decode_png(r.pop("data") or b"")
                for name, x in degraded_pixels(r, None if img is None else P.as_rgb(img)).items():
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([P.encode_png(x)], pa.binary())], ["name", "data"])

    images.write_images(joined.mapInArrow(run, "name string, data binary"), out).agg(F.count("*")).collect()


def refuse_leaks(rows: DataFrame) -> None:
    leaks = check_leakage(rows).collect()  # one row a rule
    if leaks:
        raise RuntimeError("leaks between splits: " + "; ".join(f"{r['rule']} {r['leaks']} ({', '.join(r['examples'])})" for r in leaks))


def build_probe(spark: SparkSession, out: str, img2img: Sequence[C.Generator], inpainters: Sequence[C.Generator], *, n_base: int, strengths: Sequence[float], operators: Sequence[str], holdout: Sequence[str] = (), seed: int = 0,
                cfg: Sequence[float] = (), steps: Sequence[int] = (), pairs: int = 0, backend: str = "mock") -> dict:
    """The probe sets: strengths, operators, compositing pairs; returns the statistics."""
    real = real_base(spark, out, n_base, seed).withColumn("split", F.lit("train"))
    bases = written(as_bases(real))
    by_strength = written(B.probe_strength(bases, img2img, strengths, seed, holdout, cfg, steps))
    by_operator = written(B.probe_operator(bases, img2img, inpainters, operators, seed, holdout))
    parts = [real, by_strength, by_operator]
    if pairs:
        parts.append(written(B.compositing_pairs(bases, inpainters, pairs, seed)))
    files = images.scan(spark, out)
    for p in parts[1:]:
        images.write_images(made(p, files, edit(backend)), out).agg(F.count("*")).collect()
    rows = manifest.union_all(parts)
    for name, p in (("gate1_strength", by_strength), ("gate2_operator", by_operator), ("manifest", rows)):
        manifest.write_jsonl(p, os.path.join(out, f"{name}.jsonl"))
    return reports.statistics(rows)


def features(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A manifest's rows with origin, profile and score of their images; rows without a readable image are left out."""
    rows = manifest.read_jsonl(spark, os.path.join(folder, f"{name}.jsonl"))
    measured = images.profiles(images.with_pixels(rows, images.scan(spark, folder)), ("image_id",))
    return written(rows.join(measured, "image_id").withColumn("origin", F.coalesce(F.nullif("real_image_path", F.lit("")), F.col("image_path"))))


def places(spark: SparkSession, folder: str, rows: DataFrame) -> DataFrame:
    """image_id, auc of the residual map inside against outside each mask."""
    both = images.with_pixels(images.with_pixels(rows.where("coalesce(mask_path, '') <> ''"), images.scan(spark, folder)), images.scan(spark, folder), "mask_path", "mask").select("image_id", "data", "mask")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from sievework.operators.estimators import ranked_auc

        for batch in batches:
            for r in batch.to_pylist():
                img, mask = P.decode_png(r["data"] or b""), P.decode_png(r["mask"] or b"")
                if img is None or mask is None or mask.shape[:2] != img.shape[:2]:
                    continue
                m = P.on(P.grey(P.as_rgb(mask)))
                if m.any() and not m.all():
                    yield pa.RecordBatch.from_arrays([pa.array([r["image_id"]]), pa.array([ranked_auc(m.ravel().astype(int), P.residual_stack(img).mean(0).ravel())])], ["image_id", "auc"])

    return both.mapInArrow(run, "image_id string, auc double")


def run_gates(spark: SparkSession, run: str, probe: str) -> dict:
    """All gates over a built data set and probe."""
    whole, strength, operator = features(spark, run, "manifest"), features(spark, probe, "gate1_strength"), features(spark, probe, "gate2_operator")
    row = lambda df: df.first().asDict()
    return {
        "gate0": row(gates.detection(whole, places(spark, run, whole))), "gate1": row(gates.strength(strength)), "gate2": row(gates.operators(operator)), "gate3": row(gates.increments(strength, operator)),
        "gate4": {"per_split": [r.asDict() for r in gates.by_test_split(whole).orderBy("split").collect()], "test_f": row(gates.false_alarms(whole))},
    }

