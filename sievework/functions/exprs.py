"""Scalar functions of the engine as Column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

BENCHMARK_SOURCES = ("CASIA", "Columbia", "Coverage", "NIST16", "DSO-1", "IMD2020")


def stable_hash(key: Column) -> Column:
    """First four bytes of SHA-1 as an unsigned number."""
    return F.conv(F.substring(F.sha1(key.cast("binary")), 1, 8), 16, 10).cast("long")


def hash01(key: Column, salt: Column | str) -> Column:
    """In [0, 1), from salt|key."""
    salt = F.lit(salt) if isinstance(salt, str) else salt
    return stable_hash(F.concat(salt, F.lit("|"), key)) / F.lit(4294967296.0)


def hash_pick(key: Column, salt: str, choices: Sequence) -> Column:
    return F.element_at(F.array(*[F.lit(c) for c in choices]), (stable_hash(F.concat(key, F.lit(salt))) % len(choices) + 1).cast("int"))


def rounded(x: Column, digits: int) -> Column:
    """x at so many digits, rounded by its binary value; ties, which few such values are, go to the even digit."""
    return F.replace(F.format_number(x, digits), F.lit(",")).cast("double")


def hash_strength(key: Column, low: float, high: float) -> Column:
    return rounded(F.lit(low) + F.lit(high - low) * ((stable_hash(key) % 10000) / F.lit(10000.0)), 4)


def hash_bernoulli(key: Column, share: float) -> Column:
    return (stable_hash(key) % 1000) / F.lit(1000.0) < share


def make_image_id(prefix: str, payload: Column) -> Column:
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha1(payload.cast("binary")), 1, 12))


def content_hash(data: Column) -> Column:
    return F.sha1(data)


def chain(*nodes: Column) -> Column:
    return F.concat_ws(">", *nodes)


def chain_resolution(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, "(?:^|>)rs([0-9]+)(?:>|$)", 1), F.lit("")).try_cast("int")


def nongen_chain(c: Column) -> Column:
    """Chain without generating nodes and without a leading decode; null is '', legacy stays."""
    rest = F.filter(F.split(c, ">"), lambda x: ~x.rlike("^(edit:|vae_rt:|gen:)"))
    rest = F.when(F.get(rest, 0) == "decode", F.slice(rest, 2, F.greatest(F.size(rest) - 1, F.lit(0)))).otherwise(rest)
    return F.when(c.isNull(), "").when(c == "legacy", c).otherwise(F.concat_ws(">", rest))


def roundtrip_chain(c: Column, name: str) -> Column:
    return F.when(F.coalesce(c, F.lit("")) == "", F.lit(f"vae_rt:{name}")).otherwise(F.replace(c, F.lit(">png"), F.lit(f">vae_rt:{name}>png")))


def path_name(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]+)/*$", 1)


def path_stem(path: Column) -> Column:
    return F.regexp_replace(path_name(path), "(?<=.)\\.[^.]+$", "")


def path_suffix(path: Column) -> Column:
    return F.regexp_extract(path_name(path), "(?<=.)(\\.[^.]+)$", 1)


def origin_key(real_image_path: Column, image_path: Column) -> Column:
    real = F.nullif(real_image_path, F.lit(""))
    return F.when(real.isNotNull(), path_stem(real)).otherwise(F.regexp_replace(path_stem(image_path), "__deg$", ""))


def with_stem_suffix(path: Column, mark: str) -> Column:
    return F.regexp_replace(path, "^(.*?)(\\.[^./]*)?$", f"$1{mark}$2")


def is_degraded(postprocess: Column) -> Column:
    return F.coalesce(sum((F.coalesce(postprocess[f] != "none", F.lit(False)).cast("int") for f in ("jpeg_quality", "resize", "blur", "noise")), F.lit(0)) > 0, F.lit(False))


def json_number(op_params: Column, key: str) -> Column:
    """Number at a key of a JSON object; null for strings, arrays, objects, missing keys and bad JSON."""
    return parsed_number(F.try_parse_json(op_params), key)


def parsed_number(parsed: Column, key: str) -> Column:
    """The same of a variant."""
    value = F.try_variant_get(parsed, f"$.{key}", "variant")
    numeric = F.schema_of_variant(value).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT|BOOLEAN)")
    return F.when(numeric, F.try_variant_get(parsed, f"$.{key}", "double"))


def json_has(op_params: Column, key: str) -> Column:
    return F.coalesce(F.array_contains(F.json_object_keys(op_params), key), F.lit(False))


def short_number(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(x.cast("decimal(20,6)").cast("string"), "0+$", ""), "\\.$", "")


def nuisance_cell(op_params: Column) -> Column:
    # The text is parsed once: a lambda's argument is evaluated before its body.
    both = F.transform(F.array(F.try_parse_json(op_params)), lambda v: F.struct(parsed_number(v, "cfg_scale").alias("cfg"), parsed_number(v, "steps").alias("steps")))
    text = F.transform(both, lambda n: F.concat(F.lit("cfg"), short_number(n["cfg"]), F.lit("/st"), short_number(n["steps"])))
    return F.get(text, 0)


def digitize(x: Column, edges: Sequence[float]) -> Column:
    return sum(((x >= e).cast("int") for e in edges), F.lit(0))


def area_validity(r: Column) -> Column:
    return F.when(r.between(0.01, 0.50), 1.0).otherwise(0.0)


def bucket_for_ratio(r: Column) -> Column:
    return F.when((r >= 0.01) & (r < 0.05), "small").when((r >= 0.05) & (r < 0.20), "mid").when((r >= 0.20) & (r <= 0.50), "large")


def qes_score(parts: Sequence[Column]) -> Column:
    return sum((p * w for p, w in zip(parts, (0.3, 0.2, 0.2, 0.2, 0.1), strict=True)), F.lit(0.0))


def route_from_score(q: Column) -> Column:
    return F.when(q >= 0.75, "accept").when(q >= 0.60, "review").otherwise("reject")


def bucket_from_score(q: Column) -> Column:
    return F.when(q >= 0.75, "high").when(q >= 0.60, "mid").otherwise("low")


def strength_bucket3(s: Column) -> Column:
    return F.when(s < 0.35, 0).when(s < 0.65, 1).otherwise(2)


def init_timestep(strength: Column) -> Column:
    return F.bround(strength * 1000).cast("int")


def or_else(*columns: Column) -> Column:
    """First column that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns[:-1]], columns[-1])


def lookup(key: Column, table: Mapping[str, str], default: str | None = None) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, key), F.lit(default))
