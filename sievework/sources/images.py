"""Images and masks as tables: scans of stored files, a synthetic source, sinks, and measures of them in Arrow batches.

Pixels stay in the cluster: a row holds an encoded PNG (binary), and a task decodes one at a time. What
cannot be decoded gives a row with null measures, or none where a function says so."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.functions import pixels as P

ENDINGS = (".png",)
DATASETS = ("COCO", "ImageNet", "OpenImages", "FFHQ", "Places")


def scan(spark: SparkSession, folder: str, endings: Sequence[str] = ENDINGS) -> DataFrame:
    """path, name (relative to the folder), length, data of the image files below a folder."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    lower = F.lower("path")
    wanted = F.lit(False)
    for e in endings:
        wanted = wanted | lower.endswith(e)
    below = "\\Q" + (folder if ":/" in folder else os.path.abspath(folder)).rstrip("/") + "\\E/(.*)$"
    return rows.where(wanted).select("path", F.regexp_extract("path", below, 1).alias("name"), "length", F.col("content").alias("data"))


def directory(spark: SparkSession, folder: str, dataset: str = "local", licence: str = "unknown") -> DataFrame:
    """An image source: the files of a folder in the order of their names, with what a manifest records of them."""
    return scan(spark, folder).select("name", "data", F.lit(dataset).alias("source_dataset"), F.lit(licence).alias("license"))


def synthetic(spark: SparkSession, n: int, seed: int = 0, size: tuple[int, int] = (256, 256), parts: int = 8) -> DataFrame:
    """ordinal, source_dataset, license, data of n random pictures; a picture depends on seed + ordinal alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in batch.column("id").to_pylist():
                img = P.synthetic(np.random.default_rng(seed + i), *size)
                yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([DATASETS[i % len(DATASETS)]]), pa.array(["research-only"]), pa.array([P.encode_png(img)], pa.binary())], ["ordinal", "source_dataset", "license", "data"])

    return spark.range(0, n, 1, parts).mapInArrow(run, "ordinal long, source_dataset string, license string, data binary")


def measured(df: DataFrame, measure: Callable[[np.ndarray], dict], ddl: str, data: str = "data", keep: Sequence[str] = (), drop_unreadable: bool = False) -> DataFrame:
    """keep and the fields of ddl, which measure(image) returns by name; all null for an image that cannot be read."""
    out = df.select(*keep, data)
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema.fields[: len(keep)])
    schema = f"{kept}, {ddl}" if keep else ddl
    names = [f.strip().split(" ")[0] for f in ddl.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = []
            for d in batch.column(data).to_pylist():
                img = None if d is None else P.decode_png(bytes(d))
                values.append(None if img is None else measure(img))
            readable = pa.array([v is not None or not drop_unreadable for v in values], pa.bool_())
            found = [pa.array([None if v is None else v[n] for v in values]) for n in names]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *found], [*keep, *names]).filter(readable)

    from pyspark.sql.types import StructType

    arrow = StructType.fromDDL(schema)

    def typed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(arrow)
        for batch in run(batches):
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(batch.columns, target, strict=True)], schema=target)

    return out.mapInArrow(typed, arrow)


def quality(df: DataFrame, keep: Sequence[str], least_side: int = 256) -> DataFrame:
    """keep, problems (array) of real images; unreadable ones have the problem `unreadable`."""
    rows = measured(df, lambda img: {"problems": P.check_image(img if img.ndim == 3 else None, least_side)}, "problems array<string>", keep=keep)
    return rows.withColumn("problems", F.coalesce("problems", F.array(F.lit("unreadable"))))


def hashes(df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """keep, phash (as a signed 64-bit number), content (SHA-1 of the pixels) of readable images."""
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    return measured(df, lambda img: {"phash": signed(P.phash(P.as_rgb(img))), "content": P.content_hash(P.as_rgb(img)).hex()}, "phash long, content string", keep=keep, drop_unreadable=True)


def profiles(df: DataFrame, keep: Sequence[str], sigmas: Sequence[float] = P.SIGMAS) -> DataFrame:
    """keep, profile (array), score of readable images: the residual features that the gates use."""

    def measure(img: np.ndarray) -> dict:
        stack = P.residual_stack(img, sigmas)
        return {"profile": P.profile(stack).astype(float).tolist(), "score": P.detection_score(stack)}

    return measured(df, measure, "profile array<double>, score double", keep=keep, drop_unreadable=True)


def geometry(df: DataFrame, keep: Sequence[str], data: str = "data") -> DataFrame:
    """keep, area, border, components, convexity, distance of masks."""
    names = ("area", "border", "components", "convexity", "distance")
    return measured(df, lambda m: dict(zip(names, P.mask_geometry(P.grey(P.as_rgb(m))).astype(float).tolist(), strict=True)), ", ".join(f"{n} double" for n in names), data, keep, True)


def with_pixels(rows: DataFrame, files: DataFrame, path: str = "image_path", into: str = "data") -> DataFrame:
    """Rows with the bytes of the file that their path names (null if there is none). files: name, data."""
    data = files.select(F.col("name").alias("sieve_name"), F.col("data").alias(into))
    return rows.join(data, F.col(path) == F.col("sieve_name"), "left").drop("sieve_name")


def write_images(df: DataFrame, folder: str, name: str = "name", data: str = "data") -> DataFrame:
    """Writes each row's bytes as folder/name (a name may hold folders); returns name and length of what was written.

    Each file is written beside its place and then renamed, so a task that runs twice leaves one whole file. The
    folder must be one that all executors reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done, sizes = [], []
            for n, d in zip(batch.column(name).to_pylist(), batch.column(data).to_pylist(), strict=True):
                if n is None or d is None:
                    continue
                target = os.path.join(folder, n)
                os.makedirs(os.path.dirname(target), exist_ok=True)
                part = f"{target}.{os.getpid()}.part"
                with open(part, "wb") as f:
                    f.write(d)
                    f.flush()
                    os.fsync(f.fileno())
                os.replace(part, target)
                done.append(n)
                sizes.append(len(d))
            yield pa.RecordBatch.from_arrays([pa.array(done, pa.string()), pa.array(sizes, pa.int64())], ["name", "length"])

    return df.select(name, data).mapInArrow(run, "name string, length long")
