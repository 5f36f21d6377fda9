"""Relations of the domain, made of the driver's tables. The text runs in Spark SQL and in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HOLD_GENERATORS, HOLD_LEVEL3, HOLD_SOURCES = ("held-generator",), ("held-level3",), ("held-source",)

M_ITEM = """
SELECT concat('i', l_orderkey, '_', l_linenumber, '_', l_partkey, '_', l_suppkey) AS image_id,
       concat('img/', l_orderkey, '_', l_linenumber, CASE WHEN l_partkey % 50 = 0 THEN '.jpg' ELSE '.png' END) AS image_path,
       concat('base/', l_orderkey, '.png') AS real_image_path,
       CASE WHEN l_quantity > 25 THEN concat('mask/', l_partkey, '.png') WHEN l_quantity > 20 THEN '' END AS mask_path,
       CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS is_fake,
       CASE WHEN l_linestatus <> 'F' THEN 'real_pristine' WHEN l_quantity > 25 THEN 'localization' ELSE 'whole_image_detection' END AS task_type,
       CASE WHEN p_type = 'PROMO' AND p_size < 5 THEN 'held-level3' ELSE p_type END AS manipulation_level3,
       CASE WHEN o_orderpriority = '5-LOW' AND o_orderstatus = 'P' THEN 'held-source' ELSE o_orderpriority END AS source_dataset,
       CASE WHEN p_brand = 'Brand#11' AND p_size < 10 THEN 'held-generator' ELSE p_brand END AS generator_name,
       CASE WHEN p_size > 45 THEN 'non_diffusion' WHEN p_size > 40 THEN '' ELSE p_type END AS generator_family,
       p_name AS prompt, l_suppkey AS seed, l_discount > 0.05 AS degraded,
       CASE WHEN l_returnflag = 'A' AND l_linenumber = 1 THEN 'legacy'
            WHEN l_returnflag = 'R' THEN concat('decode>rs256>edit:', p_brand, '>png')
            WHEN l_linenumber = 7 THEN NULL
            ELSE concat('gen:', p_brand, '>rs', CASE WHEN l_linenumber = 6 THEN '512' ELSE '256' END, '>png') END AS io_chain,
       CASE WHEN l_linestatus = 'F' THEN 'edited' WHEN l_linenumber = 1 THEN 'real_vae_rt' WHEN l_tax > 0.075 THEN 'unknown' ELSE 'real' END AS sample_kind,
       CASE l_suppkey % 6 WHEN 0 THEN 'inpaint' WHEN 1 THEN 'img2img' WHEN 2 THEN 'outpaint' WHEN 3 THEN 'instruct_edit' WHEN 4 THEN 'object_replacement' END AS operator,
       CASE WHEN l_tax > 0.06 THEN 'paste_feather' WHEN l_tax > 0.03 THEN 'paste' WHEN l_tax > 0.02 THEN 'overlay' END AS compositing,
       CASE WHEN l_partkey % 3 = 0 THEN 8 END AS feather_px,
       CASE WHEN l_linenumber < 6 THEN l_quantity / 60.0 END AS mask_area_ratio,
       CASE l_partkey % 6 WHEN 0 THEN NULL WHEN 1 THEN '{{oops' WHEN 2 THEN concat('{{"cfg_scale": ', CASE WHEN l_linenumber > 3 THEN '7.5' ELSE '5' END, ', "steps": ', CASE WHEN l_suppkey % 2 = 0 THEN '30' ELSE '50' END, '}}')
            WHEN 3 THEN '{{"cfg_scale": "7.5", "steps": 30}}' WHEN 4 THEN '{{"image_guidance_scale": 1.5}}' ELSE '[1]' END AS op_params,
       CASE WHEN l_quantity > 10 THEN concat('b', l_orderkey) END AS base_id,
       CASE WHEN l_linenumber = 5 THEN concat('i', l_orderkey, '_4_', l_partkey - 1, '_', l_suppkey) END AS postprocess_of,
       l_orderkey, l_linenumber, l_shipdate, l_discount
FROM {lineitem} l JOIN {part} p ON l_partkey = p_partkey JOIN {orders} o ON l_orderkey = o_orderkey"""


def tables(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names}


def m_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest proxy, without split."""
    names = ("lineitem", "part", "orders")
    df = spark.sql(M_ITEM, **tables(spark, sf_dir, *names))  # spark.sql fills the table names in
    none, set_ = F.lit("none"), F.when(F.col("degraded"), "70").otherwise("none")
    return df.withColumn("postprocess", F.struct(set_.alias("jpeg_quality"), none.alias("resize"), none.alias("blur"), none.alias("noise")))


def m_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sievework.operators.split import assign_splits

    return assign_splits(m_item(spark, sf_dir), HOLD_GENERATORS, HOLD_LEVEL3, HOLD_SOURCES)


def hash_sql(key: str) -> str:
    return f"CAST(('0x' || substr(sha1({key}), 1, 8)) AS BIGINT)"


def _h01(kind: str) -> str:
    return f"({hash_sql(f"concat('{kind}-0|', origin)")} / 4294967296.0::DOUBLE)"


ITEM_SQL = "item AS (" + M_ITEM.format(lineitem="lineitem", part="part", orders="orders") + ")"
SPLIT_SQL = f"""{ITEM_SQL},
flags AS (SELECT *, regexp_replace(regexp_extract(real_image_path, '([^/]+)/*$', 1), '\\.[^.]+$', '') AS origin FROM item),
grouped AS (SELECT *, max(generator_name = 'held-generator') OVER g AS hg, max(manipulation_level3 = 'held-level3') OVER g AS hl,
                   max(source_dataset = 'held-source') OVER g AS hs, max(is_fake) OVER g AS any_fake FROM flags WINDOW g AS (PARTITION BY origin)),
based AS (SELECT *, CASE WHEN hg THEN 'test_b' WHEN hl THEN 'test_c' WHEN hs THEN 'test_d'
                         WHEN any_fake = 0 THEN CASE WHEN {_h01('real')} < 0.60 THEN 'train' WHEN {_h01('real')} < 0.75 THEN 'val' ELSE 'test_f' END
                         ELSE CASE WHEN {_h01('fake')} < 0.70 THEN 'train' WHEN {_h01('fake')} < 0.80 THEN 'val' ELSE 'test_a' END END AS base FROM grouped),
m AS (SELECT *, CASE WHEN base = 'test_a' AND is_fake = 1 AND degraded THEN 'test_e' ELSE base END AS split FROM based)"""
