"""Registered queries of row generation, estimators, gates and table operators, each with SQL where SQL can say it."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.config import Config, Generator, PromptBank
from sievework.functions import exprs as X
from sievework.operators import builders as B
from sievework.operators import estimators as E
from sievework.operators import gates, metrics, near_images, rules, split, tables
from sievework.operators.order import with_position, written
from sievework.plans.proxies import ITEM_SQL, SPLIT_SQL, hash_sql, m_item, m_split
from sievework.plans.proxies import tables as read
from sievework.plans.queries import _AUC, NONGEN, query
from sievework.sources import images, manifest
from sievework.streaming import ingest

IMG2IMG = (Generator("m1", "f1"), Generator("m2", "f2"), Generator("mh", "f3"))
INPAINT = (Generator("p1", "f1"), Generator("p2", "f2"), Generator("ph", "f3"))
HOLD = ("mh", "ph")
CONFIG = Config("", seed=7, strength_range=(0.1, 0.9), resolution_groups={256: ["m1"], 512: ["m2"]})
BANK = PromptBank({"img2img": ["a calm sea", 'a "quoted" sign', "rain"], "inpaint": ["fill", "mend"], "object": ["a chair"], "background": ["hills", "a street", "fog", "night"]}, "v0")

BASES = """SELECT o_orderkey, concat('b', o_orderkey) AS image_id, concat('base/', o_orderkey, '.png') AS image_path, CASE WHEN o_orderkey % 4 = 0 THEN concat('base/', o_orderkey - 1, '.png') END AS real_image_path,
       concat('b', o_orderkey - o_orderkey % 2) AS base_id, o_orderpriority AS source_dataset, concat('decode>rs', CASE WHEN o_orderkey % 2 = 0 THEN 256 ELSE 512 END, '>png') AS io_chain,
       CASE WHEN o_orderkey % 2 = 0 THEN 256 ELSE 512 END AS height, 256 AS width FROM {orders}"""
ON_BASES = f"WITH base AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS bi, coalesce(real_image_path, image_path) AS okey FROM ({BASES.format(orders='orders')}))"


def bases(spark: SparkSession, d: str) -> DataFrame:
    return with_position(spark.sql(BASES, **read(spark, d, "orders")), ["o_orderkey"], "bi")


def pick(values, key: str) -> str:
    """SQL of the value that a hash of the key picks."""
    shown = ", ".join("'" + str(v).replace("'", "''") + "'" for v in values)
    return f"list_extract([{shown}], CAST({hash_sql(key)} % {len(values)} + 1 AS BIGINT))"


def iid(prefix: str, payload: str) -> str:
    return f"concat('{prefix}_', substr(sha1({payload}), 1, 12))"


def record(kind: str) -> str:
    """SQL of the nuisance record of a row with column iid."""
    cfg, steps = pick([json.dumps(float(c)) for c in CONFIG.nuisance_cfg_grid], "concat(iid, 'cfg')"), pick(CONFIG.nuisance_steps_grid, "concat(iid, 'st')")
    quoted = pick([json.dumps(p) for p in BANK.prompts[kind]], "iid")
    return f"""concat('{{"cfg_scale": ', {cfg}, ', "prompt": ', {quoted}, ', "prompt_bank_version": "v0", "steps": ', {steps}, '}}')"""


def specs(rows, hold: bool | None = None) -> str:
    some = [g for g in rows if hold is None or (g.name in HOLD) == hold]
    return "(VALUES " + ", ".join(f"({i}, '{g.name}', '{g.family}')" for i, g in enumerate(rows) if g in some) + ") g(i, name, family)"


HELD = f"({hash_sql('okey')} % 5 = 0)"
COMP = hash_sql("concat(iid, 'comp')") + " % 2 = 1"


@query(ON_BASES + f""", r AS (SELECT *, {iid('grid_i2i', "concat(image_id, '-', name)")} AS iid FROM base JOIN {specs(IMG2IMG)} ON (name = 'mh') = {HELD}),
    s AS (SELECT DISTINCT base_id AS of, height AS res FROM base), w AS (SELECT r.*, coalesce(s.res, r.height) AS gh, round(0.1::DOUBLE + (0.9 - 0.1)::DOUBLE * (({hash_sql("concat(iid, 's')")} % 10000) / 10000.0::DOUBLE), 4) AS strength
       FROM r LEFT JOIN s ON r.base_id = s.of AND s.res = CASE name WHEN 'm1' THEN 256 WHEN 'm2' THEN 512 END)
    SELECT iid AS image_id, name AS generator_name, strength, bi * 1000 + {hash_sql('name')} % 500 + 10000007 AS seed, CASE WHEN name = 'mh' THEN 'test_b' ELSE 'train' END AS split,
           {pick(BANK.prompts['img2img'], 'iid')} AS prompt, {record('img2img')} AS op_params, concat('decode>rs', gh, '>edit:', name, '>png') AS io_chain, image_path AS real_image_path, image_id AS base_id FROM w""")
def u_grid_img2img(spark, d):
    b = bases(spark, d)
    rows = B.grid_img2img(b, IMG2IMG, CONFIG, BANK, HOLD, True, b)
    return rows.select("image_id", "generator_name", "strength", "seed", "split", "prompt", "op_params", "io_chain", "real_image_path", "base_id")


@query(ON_BASES + f""", p AS (SELECT *, CASE WHEN {HELD} THEN 'ph' WHEN bi % 2 = 0 THEN 'p1' ELSE 'p2' END AS name FROM base), r AS (SELECT *, {iid('grid_outpaint', "concat(image_id, '-', name)")} AS iid,
       floor(least(height, width) * {pick(CONFIG.outpaint_border_fracs, "concat(image_id, 'bf')")}::DOUBLE) AS b FROM p)
    SELECT iid AS image_id, name AS generator_name, bi * 1000 + {hash_sql("concat('outpaint-', name)")} % 500 + 10000007 AS seed, round(1 - (height - 2 * b) * (width - 2 * b) / (height * width)::DOUBLE, 4) AS mask_area_ratio,
           CASE WHEN {COMP} THEN 'paste_feather' ELSE 'none' END AS compositing, CASE WHEN {COMP} THEN 8 END::INT AS feather_px, {record('background')} AS op_params FROM r""")
def u_grid_outpaint(spark, d):
    return B.grid_outpaint(bases(spark, d), INPAINT, CONFIG, BANK, HOLD, True).select("image_id", "generator_name", "seed", "mask_area_ratio", "compositing", "feather_px", "op_params")


STRENGTHS, CFGS, STEPS = (0.1, 0.5, 0.9), (5.0, 7.5), (30,)


@query(ON_BASES + f""", cell AS (SELECT * FROM (VALUES {', '.join(f"({s}::DOUBLE, '{s}-c{c:g}-st{t}', '{c}-{t}', '{json.dumps({'cfg_scale': c, 'steps': t}, sort_keys=True)}')" for s in STRENGTHS for c in CFGS for t in STEPS)}) v(s, k, salt, op))
    SELECT {iid('probe_s', "concat(image_id, '-', name, '-', k)")} AS image_id, s AS strength, CAST(round_even(s * 1000, 0) AS INT) AS init_timestep, name AS generator_name, CASE WHEN name = 'mh' THEN 'test_b' ELSE 'train' END AS split, op AS op_params,
           bi * 1000 + CAST(round_even(s * 100, 0) AS BIGINT) + 7 + 100000 + {hash_sql('salt')} % 99991 AS seed FROM base JOIN {specs(IMG2IMG)} ON bi % 3 = i CROSS JOIN cell""")
def u_probe_strength(spark, d):
    rows = B.probe_strength(bases(spark, d), IMG2IMG, STRENGTHS, 7, HOLD, CFGS, STEPS)
    return rows.select("image_id", "strength", "init_timestep", "generator_name", "split", "op_params", "seed")


@query(ON_BASES + f""", cell AS (SELECT 'img2img' AS op, name FROM {specs(IMG2IMG)} UNION ALL SELECT op, name FROM (VALUES ('inpaint'), ('outpaint'), ('background_editing')) o(op) CROSS JOIN {specs(INPAINT)})
    SELECT {iid('probe_op', "concat(image_id, '-', op, '-', name)")} AS image_id, op AS operator, CASE op WHEN 'img2img' THEN 'whole_image_detection' ELSE 'localization' END AS task_type,
           CASE op WHEN 'inpaint' THEN 'mask_guided_inpainting' WHEN 'img2img' THEN NULL ELSE 'image_guided_editing' END AS manipulation_level3, CASE op WHEN 'img2img' THEN 600 END::INT AS init_timestep,
           CASE WHEN name IN ('mh', 'ph') THEN 'test_b' ELSE 'train' END AS split, bi * 1000 + {hash_sql("concat(op, '-', name)")} % 500 + 7 AS seed FROM base CROSS JOIN cell""")
def u_probe_operator(spark, d):
    rows = B.probe_operator(bases(spark, d), IMG2IMG, INPAINT, ("img2img", "inpaint", "outpaint", "background_editing"), 7, HOLD)
    return rows.select("image_id", "operator", "task_type", "manipulation_level3", "init_timestep", "split", "seed")


@query(ON_BASES + f""", n AS (SELECT count(*) AS n FROM base), p AS (SELECT k, lpad(CAST(k AS VARCHAR), 4, '0') AS q FROM range(500) t(k))
    SELECT {iid('probe_cp', "concat('cp', q, '-', mode)")} AS image_id, concat('cp', q) AS pair_id, k + 7 AS seed, mode AS compositing, CASE mode WHEN 'paste_feather' THEN 8 END::INT AS feather_px, name AS generator_name, base.image_path AS real_image_path
    FROM p, n JOIN base ON bi = k % n JOIN {specs(INPAINT)} ON i = k % 3 CROSS JOIN (VALUES ('none'), ('paste_feather')) m(mode)""")
def u_pairs(spark, d):
    return B.compositing_pairs(bases(spark, d), INPAINT, 500, 7).select("image_id", "pair_id", "seed", "compositing", "feather_px", "generator_name", "real_image_path")


LEVELS = "CASE kind " + " ".join(f"WHEN '{k}' THEN '{v[0]}'" for k, v in B.LOCAL_EDITS.items()) + " END"
OPS = "CASE kind " + " ".join(f"WHEN '{k}' THEN '{v[2]}'" for k, v in B.LOCAL_EDITS.items()) + " END"
KINDS = ", ".join(f"'{k}'" for k in B.LOCAL_EDITS)


def attempts(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events")["events"].select(F.col("event_id").alias("attempt"), F.when(F.col("event_id") % 7 != 0, F.col("value") / 250).alias("ratio"), (F.col("value") / 125).alias("confidence"), (F.col("value") / 130).alias("sharpness")).where("attempt > 0")


SCORED = "0.3 * {c} + 0.2 * {s} + 0.2 * (CASE WHEN ratio BETWEEN 0.01 AND 0.5 THEN 1.0 ELSE 0.5 END)::DOUBLE + 0.2 * 0.8::DOUBLE + 0.1 * (CASE WHEN ratio BETWEEN 0.01 AND 0.5 THEN 1.0 ELSE 0.0 END)::DOUBLE"
TRIED = """, n AS (SELECT count(*) AS n FROM base), a AS (SELECT event_id AS attempt, CASE WHEN event_id % 7 <> 0 THEN value / 250 END AS ratio, value / 125 AS confidence, value / 130 AS sharpness FROM events WHERE event_id > 0),
    t AS (SELECT *, {score} AS score FROM a, n JOIN base ON bi = (attempt - 1) % n WHERE ratio BETWEEN 0.01 AND 0.5), k AS (SELECT *, row_number() OVER (ORDER BY attempt) - 1 AS k FROM t WHERE score >= 0.6)"""


@query(ON_BASES + TRIED.format(score=SCORED.format(c="0.9::DOUBLE", s="0.8::DOUBLE")) + f""", r AS (SELECT *, list_extract([{KINDS}], k % 7 + 1) AS kind, CASE WHEN {HELD} THEN 'ph' WHEN k % 2 = 0 THEN 'p1' ELSE 'p2' END AS name FROM k WHERE k < 2000),
    s AS (SELECT *, {iid('local_edit', "concat(image_id, '-', kind, '-', attempt + 7)")} AS iid FROM r)
    SELECT iid AS image_id, attempt + 7 AS seed, {LEVELS} AS manipulation_level3, {OPS} AS operator, name AS generator_name, round(ratio, 4) AS mask_area_ratio, round(score, 4) AS quality_score, CASE WHEN score >= 0.75 THEN 'high' ELSE 'mid' END AS quality_bucket,
           CASE kind WHEN 'background_editing' THEN {record('background')} WHEN 'object_insertion' THEN {record('object')} WHEN 'object_replacement' THEN {record('object')} ELSE {record('inpaint')} END AS op_params FROM s""")
def u_local(spark, d):
    rows = B.local_rows(bases(spark, d), attempts(spark, d), 2000, INPAINT, CONFIG, BANK, HOLD)
    return rows.select("image_id", "seed", "manipulation_level3", "operator", "generator_name", "mask_area_ratio", "quality_score", "quality_bucket", "op_params")


@query(ON_BASES + TRIED.format(score=SCORED.format(c="least(confidence, 1.0::DOUBLE)", s="sharpness")) + f"""
    SELECT {iid('web_forgery', "concat(image_id, '-', attempt)")} AS image_id, list_extract(['splicing', 'copy-move', 'removal'], k % 3 + 1) AS manipulation_level2, attempt AS seed, round(ratio, 4) AS mask_area_ratio FROM k WHERE k < 500""")
def u_web(spark, d):
    return B.web_rows(bases(spark, d), attempts(spark, d), 500).select("image_id", "manipulation_level2", "seed", "mask_area_ratio")


@query(f"""WITH r AS (SELECT *, i * 1000 + j + 7 AS sd, list_extract(['sea', 'town'], (i + j) % 2 + 1) AS p FROM {specs(IMG2IMG)} CROSS JOIN range(40) t(j))
    SELECT {iid('whole_gen', "concat(name, '-', sd, '-', p)")} AS image_id, name AS generator_name, p AS prompt, sd AS seed, 'diffusion' AS manipulation_level2, concat('gen:', name, '>rs256>png') AS io_chain FROM r""")
def u_whole(spark, d):
    return B.whole_rows(read(spark, d, "region")["region"], IMG2IMG, ("sea", "town"), 40, 7).select("image_id", "generator_name", "prompt", "seed", "manipulation_level2", "io_chain")


@query(f"""WITH s AS (SELECT sha1(coalesce(text, '')) AS content, source AS source_dataset FROM documents), r AS (SELECT *, {iid('real', "concat(content, '-r', size)")} AS iid, {iid('real', "concat(content, '-r256')")} AS first FROM s CROSS JOIN (VALUES (256), (512)) z(size))
    SELECT iid AS image_id, CASE WHEN size = 512 THEN concat('D0_real_pristine/', first, '.png') END AS real_image_path, first AS base_id, concat('decode>rs', size, '>png') AS io_chain, source_dataset FROM r""")
def u_real(spark, d):
    docs = read(spark, d, "documents")["documents"]
    taken = docs.select(F.sha1(F.coalesce("text", F.lit(""))).alias("content"), F.lit(256).alias("height"), F.col("source").alias("source_dataset"), F.lit("x").alias("license"))
    return B.real_rows(taken, (512, 256)).select("image_id", "real_image_path", "base_id", "io_chain", "source_dataset")


@query(f"WITH {SPLIT_SQL} SELECT image_id, image_path, manipulation_level3, base_id FROM (SELECT * FROM m WHERE coalesce(mask_path, '') <> '' ORDER BY image_id LIMIT 300)")
def u_explain_source(spark, d):
    return tables.masked(m_split(spark, d), 300).select("image_id", "image_path", "manipulation_level3", "base_id")


def as_manifest(df: DataFrame) -> DataFrame:
    return B.shaped(df, {c: F.col(c) for c in df.columns if c in manifest.FIELDS})


@query(ON_BASES + f"SELECT {iid('explain', 'image_id')} AS image_id, image_path, 'explainable' AS task_type FROM (SELECT * FROM base WHERE real_image_path IS NOT NULL ORDER BY image_id LIMIT 300)")
def u_explain(spark, d):
    rows = bases(spark, d).withColumn("mask_path", F.col("real_image_path"))
    return B.explained_rows(as_manifest(rows), 300).select("image_id", "image_path", "task_type")


def _choice(salt: str) -> str:
    return hash_sql(f"concat('7|{salt}|', image_id)")


@query(f"""WITH {ITEM_SQL}, w AS (SELECT *, {_choice('kind')} % 4 AS kind FROM item WHERE is_fake = 1 AND {_choice('take')} / 4294967296.0::DOUBLE < 0.3)
    SELECT concat(image_id, '__deg') AS image_id, regexp_replace(image_path, '(\\.[^./]*)$', '__deg\\1') AS image_path, image_id AS postprocess_of,
           CASE kind WHEN 0 THEN {pick((50, 60, 70, 80, 90, 95), "concat('7|setting|', image_id)")} ELSE 'none' END AS jpeg, CASE kind WHEN 1 THEN {pick((0.5, 0.67, 0.75, 1.5), "concat('7|setting|', image_id)")} ELSE 'none' END AS resize,
           CASE kind WHEN 2 THEN {pick(('k3', 'k5'), "concat('7|setting|', image_id)")} ELSE 'none' END AS blur, CASE kind WHEN 3 THEN {pick(('sigma3', 'sigma5', 'sigma10'), "concat('7|setting|', image_id)")} ELSE 'none' END AS noise FROM w""")
def u_postprocess(spark, d):
    rows = B.degraded_rows(as_manifest(m_item(spark, d).drop("postprocess_of")), 0.3, 7)
    return rows.select("image_id", "image_path", "postprocess_of", F.col("postprocess.jpeg_quality").alias("jpeg"), "postprocess.resize", "postprocess.blur", "postprocess.noise")


@query(f"""WITH {SPLIT_SQL} SELECT concat(image_id, '__vaert') AS image_id, regexp_replace(image_path, '\\.[^./]*$', '__vaert.png') AS image_path, image_path AS real_image_path, coalesce(base_id, image_id) AS base_id, split, 'real_vae_rt' AS sample_kind,
       CASE WHEN coalesce(io_chain, '') = '' THEN 'vae_rt:mock' ELSE replace(io_chain, '>png', '>vae_rt:mock>png') END AS io_chain FROM m
    WHERE sample_kind = 'real' AND split IN ('train', 'test_a', 'test_f') AND {hash_sql("concat(image_id, 'vaert')")} % 1000 / 1000.0::DOUBLE < 0.15""")
def u_vae_rt(spark, d):
    return B.roundtrip_rows(as_manifest(m_split(spark, d)), 0.15).select("image_id", "image_path", "real_image_path", "base_id", "split", "sample_kind", "io_chain")


@query(f"""WITH {SPLIT_SQL} SELECT split, count(*) AS n, count(*) FILTER (WHERE io_chain LIKE '%>rs512>%') AS wide FROM m WHERE split NOT IN ('test_b', 'test_f') OR io_chain IS NULL OR io_chain NOT LIKE '%>rs512>%' GROUP BY split""")
def base_resolution(spark, d):
    rows = B.base_resolution_only(m_split(spark, d), ("test_b", "test_f"), 256)
    return rows.groupBy("split").agg(F.count("*").alias("n"), F.count_if(F.coalesce(X.chain_resolution(F.col("io_chain")) == 512, F.lit(False))).alias("wide"))


OLD = """SELECT concat('i', l_orderkey, '_', l_linenumber) AS image_id, concat('img/', l_orderkey, '_', l_linenumber, '.png') AS image_path, CASE WHEN l_linenumber > 1 THEN concat('img/', l_orderkey, '_', l_partkey % 4, '.png') END AS real_image_path,
       CASE WHEN l_linenumber > 1 THEN 1 ELSE 0 END AS is_fake, CASE WHEN l_quantity > 20 THEN 'm.png' END AS mask_path, CASE WHEN l_quantity > 40 THEN 'paste' END AS compositing, CASE WHEN l_tax > 0.05 THEN 'decode>png' WHEN l_tax > 0.02 THEN '' END AS io_chain,
       CASE WHEN l_discount > 0.08 THEN 'edited' END AS sample_kind, CASE WHEN l_suppkey % 9 = 0 THEN 'known' END AS base_id FROM {lineitem}"""


@query(f"""WITH old AS ({OLD.format(lineitem='lineitem')}), real AS (SELECT image_path AS of, max(image_id) AS real_id FROM old WHERE is_fake = 0 GROUP BY 1)
    SELECT image_id, coalesce(sample_kind, CASE is_fake WHEN 1 THEN 'edited' ELSE 'real' END) AS sample_kind, coalesce(nullif(io_chain, ''), 'legacy') AS io_chain, CASE WHEN is_fake = 1 AND mask_path IS NOT NULL AND compositing IS NULL THEN 'none' ELSE compositing END AS compositing,
           coalesce(base_id, CASE WHEN real_image_path IS NULL AND is_fake = 0 THEN image_id END, real_id, real_image_path, image_id) AS base_id FROM old LEFT JOIN real ON real_image_path = of""")
def u_backfill(spark, d):
    rows = as_manifest(spark.sql(OLD, **read(spark, d, "lineitem")))
    return B.backfilled(rows).select("image_id", "sample_kind", "io_chain", "compositing", "base_id")


@query(ON_BASES + "SELECT count(*) FILTER (WHERE bi < n // 2) AS first, count(*) FILTER (WHERE bi >= n // 2) AS second, min(o_orderkey) FILTER (WHERE bi >= n // 2) AS cut FROM base, (SELECT count(*) AS n FROM base)")
def pool_halves(spark, d):
    a, b = B.halves(bases(spark, d), ["o_orderkey"])
    return b.agg(F.count("*").alias("second"), F.min("o_orderkey").alias("cut")).select(a.agg(F.count("*")).scalar().alias("first"), "second", "cut")


# Estimators.


def emb(spark, d) -> DataFrame:
    rows = read(spark, d, "embeddings")["embeddings"].select("vec_id", "label", F.col("embedding").cast("array<double>").alias("profile"))
    return rows.withColumns({"x1": F.slice("profile", 1, 1), "y": F.col("label").cast("double") / 10, "origin": F.concat(F.lit("o"), (F.col("vec_id") % 60).cast("string"))})


EMB = "WITH e AS (SELECT vec_id, label, embedding[1]::DOUBLE AS x, label / 10.0::DOUBLE AS y, concat('o', vec_id % 60) AS origin FROM embeddings)"


@query(EMB + "SELECT round(regr_slope(y, x), 9) AS slope, round(regr_intercept(y, x), 9) AS intercept FROM e")
def e_least_squares(spark, d):
    m = E.least_squares(E.moments(emb(spark, d), "x1", "y")[()])
    return spark.range(1).select(F.round(F.lit(float(m.coef[0])), 9).alias("slope"), F.round(F.lit(m.intercept), 9).alias("intercept"))


@query(EMB + ", s AS (SELECT avg(x) AS mu, stddev_pop(x) + 1e-8 AS sd, avg(y) AS my, count(*) AS n, covar_pop(x, y) AS c, var_pop(x) AS v FROM e) SELECT vec_id, round((x - mu) / sd * ((n * c / sd) / (n * v / (sd * sd) + 1.0)) + my, 8) AS p FROM e, s")
def e_ridge(spark, d):
    rows = emb(spark, d)
    return rows.select("vec_id", F.round(E.ridge(E.moments(rows, "x1", "y")[()]).column(F.col("x1")), 8).alias("p"))


@query(EMB + f", g AS (SELECT origin, row_number() OVER (ORDER BY {hash_sql("concat('0|', origin)")}, origin) - 1 AS pos, count(*) OVER () AS n FROM (SELECT DISTINCT origin FROM e)) SELECT vec_id, pos < greatest(1, round_even(n * 0.4, 0)) AS test FROM e JOIN g USING (origin)")
def e_group_split(spark, d):
    return E.group_split(emb(spark, d), "origin").select("vec_id", "test")


@query(EMB + f"SELECT vec_id, r::INT AS repeat, CAST({hash_sql("concat('3|', r, '|', origin)")} % 5 AS INT) AS fold FROM e CROSS JOIN range(4) t(r)")
def e_group_folds(spark, d):
    return E.folds(emb(spark, d), "origin", 5, 4, 3).select("vec_id", "repeat", "fold")


@query()
def e_isotonic(spark, d):
    rows = read(spark, d, "events")["events"].select("event_id", F.col("value").alias("x"), F.when(F.col("event_type") == "purchase", 1.0).otherwise(0.0).alias("y"))
    return E.isotonic(rows, rows, "x", "y", "p").select("event_id", F.round("p", 6).alias("p"))


@query()
def e_pca(spark, d):
    return E.pca(emb(spark, d), "profile").select("vec_id", F.round("pc1", 6).alias("pc1"), F.round("pc2", 6).alias("pc2"))


@query()
def e_logistic(spark, d):
    rows = emb(spark, d).withColumn("yes", (F.col("label") % 2 == 0).cast("int")).withColumn("x4", F.slice("profile", 1, 4))
    return E.logistic(rows, "x4", "yes", F.col("vec_id") % 5 != 0, rounds=40).select("vec_id", F.round("score", 6).alias("score"))


@query()
def e_out_of_fold(spark, d):
    return E.out_of_fold(emb(spark, d), "vec_id", "profile", "y", "origin", 5, 2).select("key", F.round("raw", 5).alias("raw"), F.round("calibrated", 5).alias("calibrated"))


@query()
def e_bootstrap(spark, d):
    return E.intervals(E.bootstrap(emb(spark, d).withColumn("x", F.get("x1", 0)), ["y", "x"], {"rho": E.rho, "mae": lambda y, x: float(abs(y - x).mean())}, 400, "origin", 5))


@query()
def e_evaluate(spark, d):
    rows = emb(spark, d).withColumnsRenamed({"vec_id": "image_id", "y": "strength"})
    return gates.evaluate(rows, {"main": None, "single": 1}, splits=4, repeats=1, draws=200)


@query(EMB + "SELECT round(avg(abs(y - x)), 9) AS mae FROM e")
def mean_absolute_error(spark, d):
    return E.mean_absolute_error(emb(spark, d).withColumn("x", F.get("x1", 0)), "y", "x").select(F.round("mae", 9).alias("mae"))


@query(EMB + "SELECT round(avg(r), 9) AS balanced_accuracy, count(*) AS classes FROM (SELECT y >= 0.4 AS t, avg(((x >= 0.4) = (y >= 0.4))::INT) AS r FROM e GROUP BY 1)")
def two_bucket_accuracy(spark, d):
    return E.two_bucket_accuracy(emb(spark, d).withColumn("x", F.get("x1", 0)), "y", "x", 0.4).select(F.round("balanced_accuracy", 9).alias("balanced_accuracy"), "classes")


@query("SELECT l_quantity, round(avg(l_extendedprice), 6) AS l_extendedprice, count(*) AS weight FROM lineitem GROUP BY 1")
def group_merge(spark, d):
    return E.merged(read(spark, d, "lineitem")["lineitem"], "l_quantity", "l_extendedprice").select("l_quantity", F.round("l_extendedprice", 6).alias("l_extendedprice"), "weight")


LEVEL = "SELECT l_linenumber::DOUBLE AS lo, lead(l_linenumber) OVER (ORDER BY l_linenumber)::DOUBLE AS hi, v FROM (SELECT l_linenumber, max(l_extendedprice) / l_linenumber AS v FROM lineitem GROUP BY 1)"


@query(f"SELECT min((lo + hi) / 2) FILTER (WHERE v < 30000 AND hi IS NOT NULL) AS boundary FROM ({LEVEL})")
def first_boundary(spark, d):
    rows = read(spark, d, "lineitem")["lineitem"].groupBy("l_linenumber").agg((F.max("l_extendedprice") / F.col("l_linenumber")).alias("v"))
    pairs = rows.select(F.col("l_linenumber").cast("double").alias("lo"), (F.col("l_linenumber") + 1).cast("double").alias("hi"), "v").join(rows.select(F.col("l_linenumber").cast("double").alias("hi")), "hi", "left_semi")
    return E.first_below(pairs, "v", 30000.0)


# Gates over the manifest proxy; the score is a column of the tables.


def scored(spark, d) -> DataFrame:
    return m_split(spark, d).withColumn("score", F.col("l_discount") + F.when(F.col("is_fake") == 1, F.col("l_linenumber") / 1000).otherwise(0))


SCORE = f"WITH {SPLIT_SQL}, z AS (SELECT *, l_discount + CASE WHEN is_fake = 1 THEN l_linenumber / 1000 ELSE 0 END AS score FROM m)"
TESTED = "SELECT split, is_fake AS y, score AS s FROM z WHERE split IN ('test_a', 'test_b', 'test_c', 'test_d', 'test_e') UNION ALL SELECT t, 0, score FROM z CROSS JOIN (VALUES ('test_a'), ('test_b'), ('test_c'), ('test_d'), ('test_e')) v(t) WHERE split = 'train' AND is_fake = 0"


@query(SCORE + ", au AS (" + _AUC.format(by="split,", part="PARTITION BY split", group="GROUP BY split", src=TESTED) + "), n AS (SELECT split, count(*) FILTER (WHERE y = 1) AS n_fake, count(*) FILTER (WHERE y = 0) AS n_neg FROM (" + TESTED + ") GROUP BY split) SELECT split, CASE WHEN n_fake > 0 AND n_neg > 0 THEN round(greatest(auc, 1 - auc), 4) END AS detection_auc, n_fake, n_neg FROM au JOIN n USING (split)")
def gate4_by_split(spark, d):
    return gates.by_test_split(scored(spark, d))


@query(SCORE + ", t AS (SELECT median(score) FILTER (WHERE is_fake = 1) >= median(score) FILTER (WHERE is_fake = 0) AS hi, quantile_cont(score, 0.95) FILTER (WHERE is_fake = 0) AS q95, quantile_cont(score, 0.05) FILTER (WHERE is_fake = 0) AS q5 FROM z WHERE split = 'train') SELECT round(avg((CASE WHEN hi THEN score > q95 ELSE score < q5 END)::INT), 4) AS fpr, any_value(CASE WHEN hi THEN q95 ELSE q5 END) AS threshold, any_value(CASE WHEN hi THEN 'high=fake' ELSE 'low=fake' END) AS direction FROM z, t WHERE split = 'test_f' AND is_fake = 0")
def gate4_false_alarms(spark, d):
    return gates.false_alarms(scored(spark, d))


@query(SCORE + ", au AS (" + _AUC.format(by="", part="", group="", src="SELECT is_fake AS y, score AS s FROM z") + ") SELECT round(greatest(auc, 1 - auc), 4) AS detection_auc, 0.5::DOUBLE AS localization_auc, 0::BIGINT AS n_localization, 'FAIL' AS verdict FROM au")
def gate0_detection(spark, d):
    return gates.detection(scored(spark, d))


@query(SCORE + ", au AS (" + _AUC.format(by="", part="", group="", src="SELECT is_fake AS y, score AS s FROM z WHERE is_fake = 0 OR generator_family = 'PROMO'") + ") SELECT 'PROMO' AS family, round(greatest(auc, 1 - auc), 4) AS detection_auc, count(*) FILTER (WHERE is_fake = 1 AND generator_family = 'PROMO') AS n_pos, count(*) FILTER (WHERE is_fake = 0) AS n_neg, 'EVAL-ONLY' AS verdict FROM z, au GROUP BY auc")
def gate0_cross_generator(spark, d):
    return gates.cross_generator(scored(spark, d), "PROMO")


@query(f"WITH {ITEM_SQL}, h AS (SELECT DISTINCT generator_family AS f, operator AS o FROM item WHERE operator IS NOT NULL AND generator_family IS NOT NULL) SELECT a.f AS seen, b.f AS unseen, array_to_string(list_sort(list(a.o)), ',') AS operators FROM h a JOIN h b ON a.o = b.o AND a.f <> b.f GROUP BY ALL HAVING count(*) >= 2")
def gate2_family_pairs(spark, d):
    return gates.family_pairs(m_item(spark, d)).withColumn("operators", F.array_join("operators", ","))


def embedded(spark, d) -> DataFrame:
    return emb(spark, d).select(F.col("vec_id").alias("image_id"), "origin", "profile", F.col("y").alias("strength"), F.concat(F.lit("op"), F.col("label") % 3).alias("operator"), F.concat(F.lit("f"), F.col("vec_id") % 2).alias("generator_family"), F.when(F.col("vec_id") % 4 == 0, "test_b").otherwise("train").alias("split"))


@query()
def gate1_strength(spark, d):
    return gates.strength(written(embedded(spark, d)), 100)


@query()
def gate2_operators(spark, d):
    return gates.operators(written(embedded(spark, d)))


@query()
def gate3_increments(spark, d):
    rows = written(embedded(spark, d))
    return gates.increments(rows, rows)


@query()
def gate_geometry(spark, d):
    return gates.geometry(written(embedded(spark, d).withColumn("profile", F.slice("profile", 1, 5))), rounds=20)


NUIS = "WITH c AS (SELECT event_id AS key, value AS y, value * (1 + user_id % 7) AS raw, user_id % 3 AS cfg, user_id % 2 AS steps FROM events), l AS (SELECT unnest([concat('cfg', cfg, '/st', steps), concat('cfg', cfg), concat('st', steps), 'all']) AS cell, y, raw FROM c), r AS (SELECT cell, rank() OVER (PARTITION BY cell ORDER BY y) + (count(*) OVER (PARTITION BY cell, y) - 1) / 2.0::DOUBLE AS a, rank() OVER (PARTITION BY cell ORDER BY raw) + (count(*) OVER (PARTITION BY cell, raw) - 1) / 2.0::DOUBLE AS b FROM l) SELECT cell, round(corr(a, b), 4) AS rho, count(*) AS n FROM r GROUP BY cell"


@query(NUIS)
def gate1_nuisance(spark, d):
    e = read(spark, d, "events")["events"]
    return gates.nuisance(e.select(F.col("event_id").alias("key"), F.col("value").alias("y"), (F.col("value") * (1 + F.col("user_id") % 7)).alias("raw")), e.select(F.col("event_id").alias("key"), (F.col("user_id") % 3).alias("cfg"), (F.col("user_id") % 2).alias("steps")))


# Near images.

PHASH = f"SELECT c_custkey, xor({hash_sql('concat(c_nationkey, c_mktsegment)')}, 1::BIGINT << (c_custkey % 31)::INT) AS phash FROM customer"


def customer_hashes(spark, d) -> DataFrame:
    c = read(spark, d, "customer")["customer"]
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("c_custkey") % 31).cast("int"))
    return c.select("c_custkey", X.stable_hash(F.concat(F.col("c_nationkey").cast("string"), "c_mktsegment")).bitwiseXOR(bit).alias("phash"))


@query(f"WITH h AS (SELECT DISTINCT phash FROM ({PHASH})) SELECT a.phash AS a, b.phash AS b, bit_count(xor(a.phash, b.phash))::INT AS distance FROM h a JOIN h b ON a.phash < b.phash WHERE bit_count(xor(a.phash, b.phash)) <= 5")
def near_image_pairs(spark, d):
    return near_images.near_pairs(customer_hashes(spark, d), 5)


@query()
def near_image_greedy(spark, d):
    return near_images.greedy(customer_hashes(spark, d), "c_custkey", 1).groupBy("accepted").agg(F.count("*").alias("n"))


# Tables.


@query(f"WITH {SPLIT_SQL} " + " UNION ALL ".join(f"SELECT '{f}' AS field, {f} AS value, count(*) AS n FROM m WHERE coalesce({f}, '') <> '' GROUP BY 2" for f in ("split", "task_type", "manipulation_level3", "generator_name", "operator")))
def viewer_facets(spark, d):
    return tables.facets(m_split(spark, d), ("split", "task_type", "manipulation_level3", "generator_name", "operator"))


@query(f"WITH {SPLIT_SQL} SELECT image_id FROM m WHERE split = 'train' AND operator = 'inpaint' AND is_fake = 1 AND (contains(lower(image_id), '_1_') OR contains(lower(coalesce(prompt, '')), '_1_'))")
def viewer_filter(spark, d):
    return tables.filtered(m_split(spark, d), {"split": "train", "operator": "inpaint"}, 1, "_1_").select("image_id")


@query("SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 20")
def head_rows(spark, d):
    return tables.head(read(spark, d, "events")["events"].select("event_id", "value"), 20, [F.desc("value"), F.col("event_id")])


@query(f"WITH {ITEM_SQL} SELECT generator_family, array_to_string(list(image_id ORDER BY (base_id IS NULL), base_id, image_id), ',') AS ids FROM item WHERE operator = 'inpaint' GROUP BY 1")
def ordered_lists(spark, d):
    rows = m_item(spark, d).where("operator = 'inpaint'")
    return tables.sequence_of(rows, tables.nulls_last("base_id"), ["generator_family"], "image_id").select("generator_family", F.array_join("values", ",").alias("ids"))


OFFENDERS = "SELECT *, CASE WHEN io_chain IS NULL THEN 'V5' WHEN operator = 'inpaint' AND mask_area_ratio IS NULL THEN 'V12' END AS rule"


@query(f"WITH {ITEM_SQL}, o AS ({OFFENDERS} FROM item) SELECT rule, count(*) AS total, array_to_string(list_slice(list_sort(list(DISTINCT image_id)), 1, 5), ',') AS first FROM o GROUP BY rule")
def first_offenders(spark, d):
    rule = F.when(F.col("io_chain").isNull(), "V5").when((F.col("operator") == "inpaint") & F.col("mask_area_ratio").isNull(), "V12")
    return tables.first_offenders(m_item(spark, d), rule, "image_id").withColumn("first", F.array_join("first", ","))


@query(f"WITH {ITEM_SQL}, s AS (SELECT operator FROM item GROUP BY operator HAVING count(DISTINCT source_dataset) = (SELECT count(DISTINCT source_dataset) FROM item)) SELECT operator, count(*) AS n FROM item WHERE operator IN (SELECT operator FROM s) GROUP BY operator")
def shared_classes(spark, d):
    return tables.on_shared(m_item(spark, d), "source_dataset", "operator").groupBy("operator").agg(F.count("*").alias("n"))


@query("WITH v AS (SELECT label, vec_id, embedding::DOUBLE[] AS v, lead(embedding::DOUBLE[]) OVER (PARTITION BY label ORDER BY vec_id) AS w FROM embeddings) SELECT label, vec_id, round(list_inner_product(v, w) / sqrt(list_inner_product(v, v) * list_inner_product(w, w)), 6) AS cosine FROM v WHERE w IS NOT NULL")
def consecutive_cosines(spark, d):
    return tables.consecutive_cosines(read(spark, d, "embeddings")["embeddings"], "label", "vec_id", "embedding").select("label", "vec_id", F.round("cosine", 6).alias("cosine"))


@query(f"WITH {SPLIT_SQL} SELECT split, count(*) AS n FROM m WHERE sample_kind = 'real' AND split IN ('train', 'test_a', 'test_f') GROUP BY split")
def roundtrip_eligible(spark, d):
    return m_split(spark, d).where(tables.roundtrip_eligible()).groupBy("split").agg(F.count("*").alias("n"))


@query("SELECT c_custkey, n_nationkey FROM customer JOIN nation ON n_regionkey = c_nationkey % 5 WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderkey % 25 = n_nationkey)")
def cells_remaining(spark, d):
    t = read(spark, d, "customer", "nation", "orders")
    planned = t["customer"].join(t["nation"], F.col("n_regionkey") == F.col("c_nationkey") % 5).select("c_custkey", "n_nationkey")
    return ingest.remaining(planned, t["orders"].select(F.col("o_custkey").alias("c_custkey"), (F.col("o_orderkey") % 25).cast("int").alias("n_nationkey")), ["c_custkey", "n_nationkey"])


# Records, functions, files.

RECORDS = """SELECT concat('i', l_orderkey, '_', l_linenumber) AS image_id, (CASE WHEN l_tax > 0.07 THEN 2 WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) AS is_fake, CASE WHEN l_linenumber = 7 THEN 'other' WHEN l_linestatus = 'F' THEN 'localization' ELSE 'real_pristine' END AS task_type,
       l_discount * 20 AS strength, CASE WHEN l_quantity > 30 THEN 'partial_manipulated' WHEN l_quantity > 20 THEN 'odd' END AS manipulation_level1, CASE WHEN l_partkey % 3 = 0 THEN 'splicing' END AS manipulation_level2,
       CASE WHEN l_suppkey % 4 = 0 THEN 'face_swap' END AS manipulation_level3, CASE WHEN l_partkey % 5 > 0 THEN 'm.png' END AS mask_path, CASE WHEN l_suppkey % 7 = 0 THEN 'unknown_op' ELSE 'inpaint' END AS operator FROM {lineitem}"""
PROBLEMS = [
    ("is_fake NOT IN (0, 1)", "is_fake not 0 or 1"), ("task_type = 'other'", "task_type unknown"), ("NOT strength BETWEEN 0 AND 1", "strength outside 0..1"),
    ("is_fake = 0 AND NOT (coalesce(manipulation_level1, '') = '' AND coalesce(manipulation_level2, '') = '' AND coalesce(manipulation_level3, '') = '')", "real row with manipulation levels"),
    ("is_fake = 0 AND task_type <> 'real_pristine'", "real row must be real_pristine"), ("is_fake = 1 AND coalesce(manipulation_level1, '') <> 'partial_manipulated'", "level1 unknown"),
    ("is_fake = 1 AND manipulation_level1 = 'partial_manipulated' AND mask_path IS NULL", "partial row without mask"), ("is_fake = 1 AND manipulation_level1 = 'partial_manipulated' AND task_type <> 'localization'", "partial row of other task"), ("operator = 'unknown_op'", "operator unknown"),
]


@query(f"WITH r AS ({RECORDS.format(lineitem='lineitem')}), p AS (SELECT unnest(list_filter([{', '.join(f'CASE WHEN {c} THEN {chr(39)}{t}{chr(39)} END' for c, t in PROBLEMS)}], lambda x: x IS NOT NULL)) AS problem FROM r) SELECT problem, count(*) AS n FROM p GROUP BY problem")
def record_checks(spark, d):
    rows = as_manifest(spark.sql(RECORDS, **read(spark, d, "lineitem")))
    return rows.select(F.explode(manifest.violations()).alias("problem")).groupBy("problem").agg(F.count("*").alias("n"))


@query("""SELECT event_id, sha1(coalesce(props, '')) AS content, concat_ws('>', 'decode', event_type, 'png') AS chain, replace(concat_ws('>', 'decode', event_type, 'png'), '>png', '>vae_rt:t>png') AS trip, concat('a/', event_type, '__deg.png') AS marked,
       round(0.3 * value / 500 + 0.2 * 0.5 + 0.2 * 1 + 0.2 * 0.8 + 0.1 * 1, 6) AS qes, CASE WHEN value / 500 < 0.35 THEN 0 WHEN value / 500 < 0.65 THEN 1 ELSE 2 END AS bucket3, CAST(round_even(value / 500 * 1000, 0) AS INT) AS timestep, CASE event_type WHEN 'view' THEN 'seen' WHEN 'click' THEN 'hit' ELSE 'none' END AS mapped,
       CASE WHEN event_type = 'view' THEN 'other' ELSE event_type END AS filled FROM events""")
def expr_misc(spark, d):
    e, kind = read(spark, d, "events")["events"], F.col("event_type")
    chain = X.chain(F.lit("decode"), kind, F.lit("png"))
    q = F.col("value") / 500
    return e.select(
        "event_id", X.content_hash(F.coalesce("props", F.lit("")).cast("binary")).alias("content"), chain.alias("chain"), X.roundtrip_chain(chain, "t").alias("trip"), X.with_stem_suffix(F.concat(F.lit("a/"), kind, F.lit(".png")), "__deg").alias("marked"),
        F.round(X.qes_score([q, F.lit(0.5), F.lit(1.0), F.lit(0.8), F.lit(1.0)]), 6).alias("qes"), X.strength_bucket3(q).alias("bucket3"), X.init_timestep(q).alias("timestep"), X.lookup(kind, {"view": "seen", "click": "hit"}, "none").alias("mapped"),
        X.or_else(F.when(kind == "view", "").otherwise(kind), F.lit("other")).alias("filled"),
    )


@query(_AUC.format(by="", part="", group="", src="SELECT CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS y, -l_extendedprice AS s FROM lineitem").replace("AS auc FROM", "AS a FROM").join(("SELECT greatest(a, 1 - a) AS separability FROM (", ")")))
def separability(spark, d):
    rows = read(spark, d, "lineitem")["lineitem"].select((F.col("l_linestatus") == "F").cast("int").alias("y"), (-F.col("l_extendedprice")).alias("s"))
    return metrics.auc(rows, "y", "s").select(metrics.separability(F.round("auc", 9)).alias("separability"))


@query(RECORDS.format(lineitem="lineitem").join(("WITH r AS (", ") SELECT is_fake, task_type, 2 * count(*) AS n, round(2 * sum(strength), 4) AS strength, 2 * count(manipulation_level1) AS levels FROM r GROUP BY ALL")))
def manifest_round_trip(spark, d):
    """Written as JSON lines, appended to, merged with a file that is not there, read again."""
    rows = as_manifest(spark.sql(RECORDS, **read(spark, d, "lineitem")))
    written(rows.limit(0))  # sets the shared folder
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/round-trip-{uuid.uuid4().hex}"
    manifest.write_jsonl(rows, path)
    manifest.append_jsonl(rows, path)
    back = manifest.merge(spark, [path, path + "-none"])
    out = written(back.groupBy("is_fake", "task_type").agg(F.count("*").alias("n"), F.round(F.sum("strength"), 4).alias("strength"), F.count("manipulation_level1").alias("levels")))
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)  # a row for each kind is left
    return out


# Splits that break the rules on purpose: by line, not by origin.

MIXED = "CASE l_linenumber % 4 WHEN 0 THEN 'train' WHEN 1 THEN 'test_a' WHEN 2 THEN 'val' ELSE 'test_f' END"
ON_MIXED = f"WITH {ITEM_SQL}, m AS (SELECT *, regexp_replace(regexp_extract(real_image_path, '([^/]+)/*$', 1), '\\.[^.]+$', '') AS origin, {MIXED} AS split FROM item)"


def mixed(spark, d) -> DataFrame:
    return m_item(spark, d).withColumn("split", F.expr(MIXED))


@query(ON_MIXED + "SELECT origin AS key FROM m GROUP BY origin HAVING bool_or(split = 'train') AND bool_or(split <> 'train')")
def leak_origin_mixed(spark, d):
    return split.leak_origin(mixed(spark, d))


@query(ON_MIXED + f", c AS (SELECT split, {NONGEN} AS key, bool_or(is_fake = 0) AS r, bool_or(is_fake = 1) AS f, count(*) AS n FROM m WHERE io_chain IS DISTINCT FROM 'legacy' AND NOT (is_fake = 0 AND l_linenumber = 6) GROUP BY ALL) SELECT 'V2' AS rule, split, key, n FROM (SELECT *, bool_or(r) OVER (PARTITION BY split) AS ar, bool_or(f) OVER (PARTITION BY split) AS af FROM c) WHERE r <> f AND ar AND af")
def rule_v2_mixed(spark, d):
    return rules.v2(mixed(spark, d).where("not (is_fake = 0 and l_linenumber = 6)"))


@query(ON_MIXED + "SELECT 'V4' AS rule, split, concat(rt, '/', rl) AS key, rt AS n FROM (SELECT split, count(*) FILTER (WHERE sample_kind = 'real') AS rl, count(*) FILTER (WHERE sample_kind = 'real_vae_rt') AS rt FROM m WHERE split IN ('train','test_a','test_f') GROUP BY split) WHERE rl >= 10 AND NOT (rt / rl::DOUBLE BETWEEN 0.05 AND 0.35)")
def rule_v4_mixed(spark, d):
    return rules.v4(mixed(spark, d), profile="run")


@query(ON_MIXED + """, k AS (SELECT 'origin' AS rule, origin AS key FROM m GROUP BY origin HAVING bool_or(split = 'train') AND bool_or(split <> 'train')
    UNION ALL SELECT 'prompt_seed', concat(seed, '|', prompt) FROM m GROUP BY seed, prompt HAVING bool_or(split = 'train') AND bool_or(split <> 'train') UNION ALL SELECT DISTINCT 'benchmark', source_dataset FROM m WHERE split = 'train' AND source_dataset IN ('1-URGENT'))
    SELECT rule, count(*) AS leaks, array_to_string(list_slice(list_sort(list(key)), 1, 3), ',') AS examples FROM k GROUP BY rule""")
def leak_check(spark, d):
    return split.check_leakage(mixed(spark, d), ("1-URGENT",)).withColumn("examples", F.array_join("examples", ","))


# Images and streams.


@query()
def image_quality(spark, d):
    """Synthetic pictures, as many as there are nations, measured."""
    n = read(spark, d, "nation")["nation"].count()
    made = written(images.synthetic(spark, n, 3, (64, 80)))
    found = images.hashes(made, ("ordinal",)).join(images.quality(made, ("ordinal",), 48), "ordinal").join(images.profiles(made, ("ordinal",)), "ordinal")
    return found.select("ordinal", "phash", "content", F.array_join("problems", ",").alias("problems"), F.size("profile").alias("dims"), F.round("score", 4).alias("score"))


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_counts(spark, d):
    """The windowed stream, run until all files are read, in a table of its own."""
    written(spark.range(0))  # sets the shared folder
    shared = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    here = f"{shared}/stream-{uuid.uuid4().hex}"
    read(spark, d, "events")["events"].write.parquet(f"{here}/in")
    counts = ingest.counted(spark, f"{here}/in", window="1 day", late="36500 days")

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{here}/out/batch={number}")

    counts.writeStream.outputMode("complete").foreachBatch(store).option("checkpointLocation", f"{here}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    last = spark.read.parquet(f"{here}/out")
    return last.where(F.col("batch") == last.agg(F.max("batch")).scalar()).select("start", "event_type", "n", F.round("total", 4).alias("total"))
