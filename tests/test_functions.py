import hashlib

import pytest
from pyspark.sql import functions as F

from sievework.functions import exprs as X


def rows(spark, values, *columns):
    df = spark.createDataFrame([(v,) for v in values], "x string")
    return [tuple(r) for r in df.select(*columns).collect()]


def test_hash_of_key(spark):
    keys = ["a", "", "键", "k-17"]
    want = [int.from_bytes(hashlib.sha1(k.encode()).digest()[:4], "big") for k in keys]
    assert [r[0] for r in rows(spark, keys, X.stable_hash(F.col("x")))] == want
    want = [int.from_bytes(hashlib.sha1(f"s|{k}".encode()).digest()[:4], "big") / 2**32 for k in keys]
    assert [r[0] for r in rows(spark, keys, X.hash01(F.col("x"), "s"))] == want


def test_chain(spark):
    given = ["decode>rs256>edit:sd15_inpaint>png", "gen:sd>rs256>png", "decode>rs256>vae_rt:mock>png", "decode>rs256>png", "legacy", None, "decode", ""]
    assert [r[0] for r in rows(spark, given, X.nongen_chain(F.col("x")))] == ["rs256>png"] * 4 + ["legacy", "", "", ""]
    assert [r[0] for r in rows(spark, given, X.chain_resolution(F.col("x")))] == [256, 256, 256, 256, None, None, None, None]
    assert rows(spark, ["decode>png", None, ""], X.roundtrip_chain(F.col("x"), "m")) == [("decode>vae_rt:m>png",), ("vae_rt:m",), ("vae_rt:m",)]


def test_paths(spark):
    df = spark.createDataFrame([("d/real_abc.jpg", "e/x.png"), (None, "e/real_abc__deg.png"), ("", "a/.hidden")], "r string, p string")
    assert [r[0] for r in df.select(X.origin_key(F.col("r"), F.col("p"))).collect()] == ["real_abc", "real_abc", ".hidden"]
    assert rows(spark, ["a/b.png", "b", "a/.x", "c.tar.gz"], X.path_suffix(F.col("x"))) == [(".png",), ("",), ("",), (".gz",)]
    assert rows(spark, ["a/b.png", "a/b"], X.with_stem_suffix(F.col("x"), "__deg")) == [("a/b__deg.png",), ("a/b__deg",)]


def test_json_numbers(spark):
    given = ['{"cfg_scale": 7.5, "steps": 30}', '{"cfg_scale": 5.0, "steps": 50}', '{"cfg_scale": "7.5", "steps": 30}', '{"oops"', None, "[1]", '{"cfg_scale": 5}', '{"cfg_scale": [1], "steps": 2}']
    assert [r[0] for r in rows(spark, given, X.nuisance_cell(F.col("x")))] == ["cfg7.5/st30", "cfg5/st50"] + [None] * 6


@pytest.mark.parametrize(("value", "route", "bucket", "area"), [(0.80, "accept", "high", None), (0.65, "review", "mid", None), (0.5, "reject", "low", "large"), (0.02, "reject", "low", "small"), (0.10, "reject", "low", "mid"), (0.005, "reject", "low", None)])
def test_scores(spark, value, route, bucket, area):
    q = F.lit(value)
    got = spark.range(1).select(X.route_from_score(q), X.bucket_from_score(q), X.bucket_for_ratio(q), X.digitize(q, (0.05, 0.15, 0.35, 0.7))).first()
    assert tuple(got)[:3] == (route, bucket, area)
    assert got[3] == sum(value >= e for e in (0.05, 0.15, 0.35, 0.7))


def test_quality_and_rounding(spark):
    one = [F.lit(1.0)] * 5
    got = spark.range(1).select(X.qes_score(one), X.qes_score([F.lit(1.0)] + [F.lit(0.0)] * 4), X.init_timestep(F.lit(0.6)), X.or_else(F.lit(""), F.lit("b"))).first()
    assert (round(got[0], 9), round(got[1], 9), got[2], got[3]) == (1.0, 0.3, 600, "b")
