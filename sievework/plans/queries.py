"""Registered queries of the engine's own operators, each with SQL over the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.functions import exprs as X
from sievework.operators import metrics, rules, split, stats
from sievework.plans.proxies import HOLD_GENERATORS, ITEM_SQL, SPLIT_SQL, hash_sql, m_item, m_split, tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        key = name or f.__name__
        QUERIES[key] = f
        if sql is not None:
            ORACLE_SQL[key] = sql
        return f

    return register


ON_SPLIT, ON_ITEM = f"WITH {SPLIT_SQL}\n", f"WITH {ITEM_SQL}\n"
NONGEN = """CASE WHEN io_chain IS NULL THEN '' WHEN io_chain = 'legacy' THEN 'legacy' ELSE regexp_replace(array_to_string(list_filter(string_split(io_chain, '>'), lambda x: NOT regexp_matches(x, '^(edit:|vae_rt:|gen:)')), '>'), '^decode(>|$)', '') END"""
CFG = "CASE WHEN json_valid(op_params) AND json_type(op_params) = 'OBJECT' AND json_type(op_params, '$.cfg_scale') IN ('BIGINT','UBIGINT','DOUBLE') AND json_type(op_params, '$.steps') IN ('BIGINT','UBIGINT','DOUBLE') THEN concat('cfg', regexp_replace(regexp_replace(CAST(CAST(json_extract_string(op_params, '$.cfg_scale') AS DECIMAL(20,6)) AS VARCHAR), '0+$', ''), '\\.$', ''), '/st', regexp_replace(regexp_replace(CAST(CAST(json_extract_string(op_params, '$.steps') AS DECIMAL(20,6)) AS VARCHAR), '0+$', ''), '\\.$', '')) END"
MASKED = "('inpaint', 'outpaint', 'object_replacement', 'background_editing')"
BUCKET = "((mask_area_ratio >= 0.05)::INT + (mask_area_ratio >= 0.15)::INT + (mask_area_ratio >= 0.35)::INT + (mask_area_ratio >= 0.7)::INT)"


@query(ON_SPLIT + "SELECT split, is_fake, count(*) AS n FROM m GROUP BY ALL")
def split_assign(spark, d):
    return m_split(spark, d).groupBy("split", "is_fake").agg(F.count("*").alias("n"))


@query(ON_SPLIT + "SELECT source_dataset, split, count(*) AS n, count(DISTINCT origin) AS origins FROM m GROUP BY ALL")
def split_stats_by_domain(spark, d):
    return m_split(spark, d).groupBy("source_dataset", "split").agg(F.count("*").alias("n"), F.countDistinct(X.origin_key(F.col("real_image_path"), F.col("image_path"))).alias("origins"))


@query(ON_SPLIT + "SELECT origin AS key FROM m GROUP BY origin HAVING bool_or(split = 'train') AND bool_or(split <> 'train')")
def leak_origin(spark, d):
    return split.leak_origin(m_split(spark, d))


@query(ON_SPLIT + "SELECT concat(seed, '|', prompt) AS key FROM m GROUP BY seed, prompt HAVING bool_or(split = 'train') AND bool_or(split <> 'train')")
def leak_prompt_seed(spark, d):
    return split.leak_prompt_seed(m_split(spark, d))


@query(ON_SPLIT + "SELECT generator_name AS key FROM m WHERE generator_name <> '' GROUP BY 1 HAVING bool_or(split = 'train') AND bool_or(split = 'test_b')")
def leak_generator(spark, d):
    return split.leak_generator(m_split(spark, d))


@query(ON_SPLIT + "SELECT DISTINCT source_dataset AS key FROM m WHERE split = 'train' AND source_dataset IN ('1-URGENT', '2-HIGH')")
def leak_benchmark(spark, d):
    return split.leak_benchmark(m_split(spark, d), ("1-URGENT", "2-HIGH"))


_V = {
    1: f"SELECT split, suffix AS key, count(*) AS n FROM (SELECT *, regexp_extract(image_path, '.(\\.[^./]+)$', 1) AS suffix FROM m WHERE io_chain IS DISTINCT FROM 'legacy' AND NOT degraded) WHERE suffix <> '.png' GROUP BY ALL",
    2: f"SELECT split, key, n FROM (SELECT split, key, r, f, n, bool_or(r) OVER (PARTITION BY split) AS ar, bool_or(f) OVER (PARTITION BY split) AS af FROM (SELECT split, {NONGEN} AS key, bool_or(is_fake = 0) AS r, bool_or(is_fake = 1) AS f, count(*) AS n FROM m WHERE io_chain IS DISTINCT FROM 'legacy' GROUP BY ALL)) WHERE r <> f AND ar AND af",
    3: f"SELECT NULL::VARCHAR AS split, key, count(*) AS n FROM (SELECT unnest([CASE WHEN sample_kind NOT IN ('real','real_vae_rt','edited') THEN concat('kind:', sample_kind) END, CASE WHEN compositing NOT IN ('none','paste','paste_feather') THEN concat('compositing:', compositing) END, CASE WHEN operator IN {MASKED} AND compositing IS NULL THEN 'compositing missing' END, CASE WHEN operator IN {MASKED} AND compositing = 'paste_feather' AND feather_px IS NULL THEN 'feather_px missing' END]) AS key FROM m) WHERE key IS NOT NULL GROUP BY ALL",
    4: "SELECT split, concat(rt, '/', rl) AS key, rt AS n FROM (SELECT split, count(*) FILTER (WHERE sample_kind = 'real') AS rl, count(*) FILTER (WHERE sample_kind = 'real_vae_rt') AS rt FROM m WHERE split IN ('train','test_a','test_f') GROUP BY split) WHERE rl >= 10 AND NOT (rt / rl::DOUBLE BETWEEN 0.05 AND 0.35)",
    5: "SELECT NULL::VARCHAR AS split, coalesce(io_chain, 'missing') AS key, count(*) AS n FROM m WHERE io_chain IS NULL OR io_chain = 'legacy' GROUP BY ALL",
    6: "SELECT NULL::VARCHAR AS split, key, count(*) AS n FROM (SELECT CASE WHEN op_params IS NULL OR NOT json_valid(op_params) OR json_type(op_params) <> 'OBJECT' THEN 'not an object' WHEN NOT list_contains(json_keys(op_params), 'image_guidance_scale') THEN 'key missing' END AS key FROM m WHERE operator = 'instruct_edit') WHERE key IS NOT NULL GROUP BY ALL",
    8: "SELECT NULL::VARCHAR AS split, concat('base:', base_id) AS key, count(DISTINCT coalesce(split, '∅')) AS n FROM m WHERE base_id <> '' AND coalesce(postprocess_of, '') = '' GROUP BY base_id HAVING count(DISTINCT coalesce(split, '∅')) > 1 UNION ALL SELECT c.split, concat('mother:', p.split) AS key, count(*) FROM m c JOIN (SELECT image_id, arg_max(split, image_path) AS split FROM m GROUP BY image_id) p ON c.postprocess_of = p.image_id WHERE c.postprocess_of <> '' AND c.split IS DISTINCT FROM p.split AND NOT (p.split = 'test_a' AND c.split = 'test_e') GROUP BY c.split, p.split",
    9: "SELECT split, concat(generator_name, '/', generator_family) AS key, count(*) AS n FROM m WHERE split IN ('train','val') AND (generator_name IN ('held-generator','Brand#22') OR generator_family IN ('held-generator','Brand#22')) GROUP BY ALL",
    10: "SELECT split, operator AS key, count(*) AS n FROM m WHERE split IN ('train','val') AND operator = 'object_replacement' GROUP BY ALL",
    11: f"SELECT NULL::VARCHAR AS split, 'not recorded' AS key, count(*) AS n FROM e WHERE cell IS NULL HAVING count(*) > 0 UNION ALL SELECT split, cell AS key, count(*) AS n FROM e WHERE cell IS NOT NULL GROUP BY split, cell HAVING count(*) < 200",
    12: f"SELECT NULL::VARCHAR AS split, 'no ratio' AS key, count(*) AS n FROM m WHERE operator IN {MASKED} AND mask_area_ratio IS NULL HAVING count(*) > 0 UNION ALL SELECT NULL, concat('bucket ', i), coalesce(n, 0) FROM range(4) t(i) LEFT JOIN (SELECT {BUCKET} AS b, count(*) AS n FROM m WHERE operator IN {MASKED} AND mask_area_ratio IS NOT NULL GROUP BY 1) ON b = i WHERE coalesce(n, 0) < 4000",
}
_EDIT = f", e AS (SELECT *, {CFG} AS cell FROM m WHERE is_fake = 1 AND io_chain <> 'legacy' AND contains(io_chain, 'edit:') AND generator_family IS DISTINCT FROM 'non_diffusion' AND generator_name IS DISTINCT FROM 'manual-web-edit')"
_RULES: dict[int, Callable[[DataFrame], DataFrame]] = {
    1: rules.v1, 2: rules.v2, 3: rules.v3, 4: rules.v4, 5: rules.v5, 6: rules.v6, 8: rules.v8, 9: lambda df: rules.v9(df, (*HOLD_GENERATORS, "Brand#22")),
    10: lambda df: rules.v10(df, "object_replacement"), 11: lambda df: rules.v11(df, 200), 12: lambda df: rules.v12(df, 4000),
}


def _rule(n: int) -> None:
    QUERIES[f"rule_v{n}"] = lambda spark, d: _RULES[n](m_split(spark, d))
    ORACLE_SQL[f"rule_v{n}"] = f"WITH {SPLIT_SQL}{_EDIT} SELECT 'V{n}' AS rule, * FROM ({_V[n]})"


for _n in _RULES:
    _rule(_n)

M_PAIR = "SELECT concat('p', conv_id, '_', turn // 2) AS pair_id, CASE WHEN conv_id % 3 = 0 THEN 'nd_pair' ELSE 'compositing_pair' END AS probe_group, conv_id AS seed, CASE WHEN conv_id % 7 = 0 THEN role ELSE 'base' END AS real_image_path, 'mask' AS mask_path, CASE WHEN conv_id % 5 = 0 THEN role ELSE 'gen' END AS generator_name, CASE WHEN turn % 2 = 0 THEN 'none' WHEN conv_id % 4 = 0 THEN 'paste' ELSE 'paste_feather' END AS compositing FROM {conversations}"


@query(
    "WITH p AS (" + M_PAIR.format(conversations="conversations") + """),
    g AS (SELECT pair_id, count(*) AS n, count(DISTINCT seed) = 1 AS seed, count(DISTINCT real_image_path) = 1 AS base, count(DISTINCT generator_name) = 1 AS gen, count(DISTINCT compositing) = 1 AS comp,
                 count(DISTINCT probe_group) > 1 AS mixed, min(probe_group) = 'compositing_pair' AS pair, list_sort(list(DISTINCT compositing)) AS s FROM p GROUP BY pair_id),
    w AS (SELECT pair_id, n, unnest([CASE WHEN n <> 2 THEN 'count' END, CASE WHEN n = 2 AND NOT seed THEN 'seed' END, CASE WHEN n = 2 AND NOT base THEN 'real_image_path' END, CASE WHEN n = 2 AND mixed THEN 'probe_group' END,
                 CASE WHEN n = 2 AND NOT mixed AND pair AND s <> ['none', 'paste_feather'] THEN 'compositing' END, CASE WHEN n = 2 AND NOT mixed AND pair AND NOT gen THEN 'generator_name' END,
                 CASE WHEN n = 2 AND NOT mixed AND NOT pair AND gen THEN 'generator_name' END, CASE WHEN n = 2 AND NOT mixed AND NOT pair AND NOT comp THEN 'compositing' END]) AS why FROM g)
    SELECT 'V7' AS rule, NULL::VARCHAR AS split, concat(pair_id, ':', why) AS key, n FROM w WHERE why IS NOT NULL"""
)
def rule_v7(spark, d):
    return rules.v7(spark.sql(M_PAIR.replace("//", "div"), **tables(spark, d, "conversations")))


_ALL = " UNION ALL ".join(f"SELECT 'V{n}' AS rule, * FROM ({_V[n]})" for n in (1, 2, 3, 4, 5, 6, 8, 9, 10, 11, 12))


@query(f"WITH {SPLIT_SQL}{_EDIT} SELECT rule, count(*) AS violations, sum(n)::BIGINT AS n FROM ({_ALL}) GROUP BY rule")
def rules_all(spark, d):
    df = m_split(spark, d).withColumns({c: F.lit(None).cast("string") for c in ("probe_group", "pair_id")})
    found = rules.check_all(df, "run", (*HOLD_GENERATORS, "Brand#22"), "object_replacement", 200, 4000)
    return found.groupBy("rule").agg(F.count("*").alias("violations"), F.sum("n").alias("n"))


@query(ON_ITEM + "SELECT count(*) AS total, count(*) FILTER (WHERE is_fake = 0) AS \"real\", count(*) FILTER (WHERE is_fake = 1) AS fake, count(*) FILTER (WHERE coalesce(mask_path, '') <> '') AS with_mask FROM item")
def stats_totals(spark, d):
    return stats.totals(m_item(spark, d))


@query(ON_SPLIT + " UNION ALL ".join(f"SELECT '{f}' AS field, {f} AS value, count(*) AS n FROM m WHERE {f} IS NOT NULL AND ({f} <> '' OR '{f}' = 'task_type') GROUP BY {f}" for f in stats.FREQUENCIES))
def stats_frequencies(spark, d):
    return stats.frequencies(m_split(spark, d))


@query(ON_SPLIT + f'SELECT split, {NONGEN} AS chain, count(*) FILTER (WHERE is_fake = 0) AS "real", count(*) FILTER (WHERE is_fake <> 0) AS fake FROM m GROUP BY ALL')
def stats_chain_by_split(spark, d):
    return stats.chain_by_split(m_split(spark, d))


@query(ON_ITEM + f"SELECT cell, count(*) AS n FROM (SELECT {CFG} AS cell FROM item) WHERE cell IS NOT NULL GROUP BY cell")
def stats_nuisance_cell(spark, d):
    return stats.by_nuisance_cell(m_item(spark, d))


@query(ON_ITEM + f"SELECT concat('b', {BUCKET}) AS bucket, count(*) AS n FROM item WHERE mask_area_ratio IS NOT NULL GROUP BY ALL")
def stats_area_bucket(spark, d):
    return stats.by_area_bucket(m_item(spark, d))


@query(f"SELECT o_orderkey, list_extract(['5', '7.5', '10'], CAST({hash_sql('concat(o_orderkey, ' + chr(39) + 'cfg' + chr(39) + ')')} % 3 + 1 AS BIGINT)) AS cfg, {hash_sql('CAST(o_orderkey AS VARCHAR)')} % 1000 / 1000.0::DOUBLE < 0.2 AS taken, round(0.1::DOUBLE + (0.9 - 0.1)::DOUBLE * (({hash_sql('CAST(o_orderkey AS VARCHAR)')} % 10000) / 10000.0::DOUBLE), 4) AS strength, {hash_sql('CAST(o_orderkey AS VARCHAR)')} AS h FROM orders")
def hash_policies(spark, d):
    key = F.col("o_orderkey").cast("string")
    return tables(spark, d, "orders")["orders"].select("o_orderkey", X.hash_pick(key, "cfg", ("5", "7.5", "10")).alias("cfg"), X.hash_bernoulli(key, 0.2).alias("taken"), X.hash_strength(key, 0.1, 0.9).alias("strength"), X.stable_hash(key).alias("h"))


@query("SELECT doc_id, concat('doc_', substr(sha1(text), 1, 12)) AS image_id FROM documents WHERE text IS NOT NULL")
def make_id(spark, d):
    return tables(spark, d, "documents")["documents"].where("text is not null").select("doc_id", X.make_image_id("doc", F.col("text")).alias("image_id"))


@query(r"SELECT page_id, regexp_replace(regexp_extract(url, '([^/]+)/*$', 1), '(.)\.[^.]+$', '\1') AS stem, regexp_extract(regexp_extract(url, '([^/]+)/*$', 1), '.(\.[^.]+)$', 1) AS suffix FROM pages")
def path_parts(spark, d):
    return tables(spark, d, "pages")["pages"].select("page_id", X.path_stem(F.col("url")).alias("stem"), X.path_suffix(F.col("url")).alias("suffix"))


@query(ON_ITEM + f"SELECT DISTINCT io_chain, {NONGEN} AS nongen, TRY_CAST(nullif(regexp_extract(io_chain, '(?:^|>)rs([0-9]+)(?:>|$)', 1), '') AS INT) AS resolution FROM item")
def chain_functions(spark, d):
    return m_item(spark, d).select("io_chain").distinct().select("io_chain", X.nongen_chain(F.col("io_chain")).alias("nongen"), X.chain_resolution(F.col("io_chain")).alias("resolution"))


@query("SELECT event_id, round(value / 500, 4) AS q, CASE WHEN value / 500 >= 0.75 THEN 'accept' WHEN value / 500 >= 0.60 THEN 'review' ELSE 'reject' END AS route, CASE WHEN value / 500 >= 0.75 THEN 'high' WHEN value / 500 >= 0.60 THEN 'mid' ELSE 'low' END AS bucket, CASE WHEN value / 500 BETWEEN 0.01 AND 0.50 THEN 1.0 ELSE 0.0 END::DOUBLE AS valid, CASE WHEN value / 500 < 0.01 THEN NULL WHEN value / 500 < 0.05 THEN 'small' WHEN value / 500 < 0.20 THEN 'mid' WHEN value / 500 <= 0.5 THEN 'large' END AS area FROM events")
def qes_route(spark, d):
    q = F.col("value") / 500
    return tables(spark, d, "events")["events"].select("event_id", F.round(q, 4).alias("q"), X.route_from_score(q).alias("route"), X.bucket_from_score(q).alias("bucket"), X.area_validity(q).alias("valid"), X.bucket_for_ratio(q).alias("area"))


_AUC = "WITH c AS (SELECT {by} s, count(*) FILTER (WHERE y = 1) AS p, count(*) FILTER (WHERE y <> 1) AS q FROM ({src}) GROUP BY ALL), w AS (SELECT *, sum(q) OVER ({part} ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - q AS lower FROM c) SELECT {by} round(CASE WHEN sum(p) * sum(q) > 0 THEN (sum(p * (lower + q / 2.0::DOUBLE)) / (sum(p) * sum(q))::DOUBLE) ELSE 0.5 END, 9)::DOUBLE AS auc FROM w {group}"
_LINES = "SELECT l_returnflag, CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS y, l_extendedprice AS s FROM lineitem"


@query(_AUC.format(by="", part="", group="", src=_LINES))
def auc(spark, d):
    rows = tables(spark, d, "lineitem")["lineitem"].select((F.col("l_linestatus") == "F").cast("int").alias("y"), F.col("l_extendedprice").alias("s"))
    return metrics.auc(rows, "y", "s").select(F.round("auc", 9).alias("auc"))


@query(_AUC.format(by="l_returnflag,", part="PARTITION BY l_returnflag", group="GROUP BY l_returnflag", src=_LINES))
def auc_by_group(spark, d):
    rows = tables(spark, d, "lineitem")["lineitem"].select("l_returnflag", (F.col("l_linestatus") == "F").cast("int").alias("y"), F.col("l_extendedprice").alias("s"))
    return metrics.auc(rows, "y", "s", ("l_returnflag",)).select("l_returnflag", F.round("auc", 9).alias("auc"))


@query("WITH r AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0::DOUBLE AS a, rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0::DOUBLE AS b FROM lineitem) SELECT round(corr(a, b), 6) AS rho, count(*) AS n FROM r")
def spearman(spark, d):
    return metrics.spearman(tables(spark, d, "lineitem")["lineitem"], "l_quantity", "l_extendedprice").select(F.round("rho", 6).alias("rho"), "n")


_CENTROID = """WITH cells AS (SELECT vec_id, label, vec_id % 5 <> 0 AS tr, unnest(embedding)::DOUBLE AS v, unnest(range(len(embedding))) AS dim FROM embeddings),
sc AS (SELECT dim, avg(v) AS mu, stddev_pop(v) + 1e-8 AS sd FROM cells WHERE tr GROUP BY dim),
z AS (SELECT vec_id, label, tr, dim, (v - mu) / sd AS z FROM cells JOIN sc USING (dim)),
c AS (SELECT label AS cls, dim, avg(z) AS c FROM z WHERE tr GROUP BY ALL),
dd AS (SELECT vec_id, label, cls, round(sum((z - c) * (z - c)), 9) AS d FROM z JOIN c USING (dim) WHERE NOT tr GROUP BY ALL),
g AS (SELECT vec_id, label, arg_min(cls, (d, cls)) AS guess FROM dd GROUP BY ALL)
"""


def _centroid(spark, d):
    df = tables(spark, d, "embeddings")["embeddings"].withColumn("vector", F.col("embedding").cast("array<double>"))
    return metrics.nearest_centroid(df, F.col("vec_id") % 5 != 0, "vec_id", "vector", "label")


@query(_CENTROID + "SELECT * FROM g")
def nearest_centroid(spark, d):
    return _centroid(spark, d)


@query(_CENTROID + "SELECT round(avg(r), 9) AS balanced_accuracy, count(*) AS classes FROM (SELECT label, avg((label = guess)::INT) AS r FROM g GROUP BY label)")
def balanced_accuracy(spark, d):
    return metrics.balanced_accuracy(_centroid(spark, d), "label", "guess").select(F.round("balanced_accuracy", 9).alias("balanced_accuracy"), "classes")


@query(_CENTROID + "SELECT label AS truth, guess, count(*) AS n FROM g GROUP BY ALL")
def confusion(spark, d):
    return metrics.confusion(_centroid(spark, d), "label", "guess")


@query("SELECT event_type, round(quantile_cont(value, 0.05), 9) AS q0050, round(quantile_cont(value, 0.95), 9) AS q0950 FROM events GROUP BY event_type")
def quantile_bounds(spark, d):
    q = metrics.quantiles(tables(spark, d, "events")["events"], "value", (0.05, 0.95), ("event_type",))
    return q.select("event_type", F.round("q0050", 9).alias("q0050"), F.round("q0950", 9).alias("q0950"))


@query("WITH n AS (SELECT count(*) AS n FROM events), r AS (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS i FROM events) SELECT event_id FROM r WHERE i IN (SELECT CAST(round_even(g * (n - 1) / 24.0, 0) AS BIGINT) FROM range(25) t(g), n)")
def even_subsample(spark, d):
    return metrics.even_subsample(tables(spark, d, "events")["events"].select("event_id"), ("event_id",), 25)


@query("WITH lv AS (SELECT event_type AS lo, lead(event_type) OVER (ORDER BY event_type) AS hi FROM (SELECT DISTINCT event_type FROM events)), x AS (SELECT lo, hi, 0 AS y, value AS s FROM lv JOIN events ON event_type = lo WHERE hi IS NOT NULL UNION ALL SELECT lo, hi, 1, value FROM lv JOIN events ON event_type = hi), " + _AUC.format(by="lo, hi,", part="PARTITION BY lo, hi", group="GROUP BY lo, hi", src="SELECT * FROM x").removeprefix("WITH "))
def adjacent_level_auc(spark, d):
    a = metrics.adjacent_auc(tables(spark, d, "events")["events"], "event_type", "value")
    return a.select("lo", "hi", F.round("auc", 9).alias("auc"))
