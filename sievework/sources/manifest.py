"""The typed manifest: one record per media sample, kept as a DataFrame and exchanged as JSON lines."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

POSTPROCESS = "struct<jpeg_quality:string,resize:string,blur:string,noise:string>"
EXPLANATION = "struct<visual_evidence:string,semantic_inconsistency:string,manipulation_type:string,localization_description:string>"
# The record's fields, their types and order.
FIELDS: dict[str, str] = {
    "image_id": "string",
    "image_path": "string",
    "real_image_path": "string",
    "mask_path": "string",
    "is_fake": "int",
    "task_type": "string",
    "manipulation_level1": "string",
    "manipulation_level2": "string",
    "manipulation_level3": "string",
    "manipulation_level4": "string",
    "source_dataset": "string",
    "generator_name": "string",
    "generator_family": "string",
    "prompt": "string",
    "negative_prompt": "string",
    "seed": "long",
    "steps": "int",
    "sampler": "string",
    "cfg_scale": "double",
    "mask_source": "string",
    "mask_area_ratio": "double",
    "quality_score": "double",
    "strength": "double",
    "postprocess": POSTPROCESS,
    "quality_bucket": "string",
    "split": "string",
    "license": "string",
    "explanation": EXPLANATION,
    "init_timestep": "int",
    "operator": "string",
    "op_params": "string",
    "io_chain": "string",
    "sample_kind": "string",
    "compositing": "string",
    "feather_px": "int",
    "probe_group": "string",
    "pair_id": "string",
    "base_id": "string",
    "postprocess_of": "string",
}
SCHEMA = ", ".join(f"{n} {t}" for n, t in FIELDS.items())

# Fixed values of the record's vocabularies.
TASK_TYPES = ("real_pristine", "whole_image_detection", "localization", "explainable")
LEVEL1 = ("whole_generated", "partial_manipulated")
LEVEL2 = ("diffusion", "GAN", "autoregressive", "Photoshop-editing", "DeepFake", "AIGC-editing", "copy-move", "splicing", "removal")
LEVEL2_WHOLE = ("diffusion", "GAN", "autoregressive")
LEVEL3 = ("conditional_generation", "unconditional_generation", "text_guided_editing", "image_guided_editing", "mask_guided_inpainting", "object_replacement", "object_removal", "face_swap", "text_editing")
OPERATORS = ("img2img", "inpaint", "outpaint", "object_insertion", "object_replacement", "object_removal", "background_editing", "attribute_editing", "text_editing", "face_editing", "instruct_edit")
SPLITS = ("train", "val", "test_a", "test_b", "test_c", "test_d", "test_e", "test_f")


def read_jsonl(spark: SparkSession, *paths: str, audit: bool = False) -> DataFrame:
    """The manifest in the files. A line that is no record fails the read, or with audit ends in column _corrupt."""
    if audit:
        return spark.read.schema(SCHEMA + ", _corrupt string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(list(paths))
    return spark.read.schema(SCHEMA).option("mode", "FAILFAST").json(list(paths))


#: Lines of a file at most, as a compressed file is read by one task.
FILE_LINES = 1_000_000


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite", compression: str = "gzip") -> None:
    """All fields of every record, nulls too. Names and nulls are most of a line, so lines are compressed ("none": plain)."""
    df.write.mode(mode).option("ignoreNullFields", False).option("compression", compression).option("maxRecordsPerFile", FILE_LINES).json(path)


def append_jsonl(df: DataFrame, path: str) -> None:
    write_jsonl(df, path, "append")


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """All rows of all manifests, repeats kept."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def merge(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Union of the manifests whose path exists."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    there = [p for p in paths if (path := jvm.org.apache.hadoop.fs.Path(p)).getFileSystem(conf).exists(path)]
    return union_all([read_jsonl(spark, p) for p in there]) if there else spark.createDataFrame([], SCHEMA)


def violations(operators: Sequence[str] = OPERATORS) -> Column:
    """array<string> of what is wrong with a record; empty when it is consistent."""
    fake, l1, l2, l3 = F.col("is_fake") == 1, *(F.col(f"manipulation_level{i}") for i in (1, 2, 3))
    blank = lambda c: F.coalesce(c, F.lit("")) == ""
    unit = lambda c: F.col(c).isNotNull() & ~F.col(c).between(0, 1)
    inside = lambda c, values: F.coalesce(c.isin(list(values)), F.lit(False))
    checks = [
        (~inside(F.col("is_fake"), (0, 1)), "is_fake not 0 or 1"),
        (~inside(F.col("task_type"), TASK_TYPES), "task_type unknown"),
        *[(unit(c), f"{c} outside 0..1") for c in ("mask_area_ratio", "quality_score", "strength")],
        ((F.col("is_fake") == 0) & ~(blank(l1) & blank(l2) & blank(l3)), "real row with manipulation levels"),
        ((F.col("is_fake") == 0) & (F.col("task_type") != "real_pristine"), "real row must be real_pristine"),
        (fake & ~inside(l1, LEVEL1), "level1 unknown"),
        (fake & l2.isNotNull() & ~inside(l2, LEVEL2), "level2 unknown"),
        (fake & l3.isNotNull() & ~inside(l3, LEVEL3), "level3 unknown"),
        (fake & (l1 == "partial_manipulated") & blank(F.col("mask_path")), "partial row without mask"),
        (fake & (l1 == "partial_manipulated") & ~inside(F.col("task_type"), ("localization", "explainable")), "partial row of other task"),
        (fake & (l1 == "whole_generated") & l2.isNotNull() & ~inside(l2, LEVEL2_WHOLE), "whole row with editing level2"),
        (F.col("operator").isNotNull() & ~inside(F.col("operator"), operators), "operator unknown"),
    ]
    return F.array_compact(F.array(*[F.when(cond, F.lit(text)) for cond, text in checks]))
