import json

import pytest
from pyspark.sql import functions as F

from sievework.operators import rules, split, stats
from sievework.plans import more
from sievework.sources import manifest as M

POST = {"jpeg_quality": "none", "resize": "none", "blur": "none", "noise": "none"}


def frame(spark, *rows):
    names = [n for n in M.FIELDS]
    base = {"image_id": "i", "image_path": "i.png", "is_fake": 0, "task_type": "real_pristine", "postprocess": POST}
    return spark.createDataFrame([tuple(({**base, **r}).get(n) for n in names) for r in rows], M.SCHEMA)


def found(df):
    return sorted(((r.split, r.key, r.n) for r in df.collect()), key=lambda x: tuple(map(str, x)))


def test_record_checks(spark):
    whole = {"is_fake": 1, "task_type": "whole_image_detection", "manipulation_level1": "whole_generated", "manipulation_level2": "diffusion"}
    part = {"is_fake": 1, "task_type": "localization", "manipulation_level1": "partial_manipulated", "manipulation_level2": "AIGC-editing", "mask_path": "m.png"}
    df = frame(spark, {}, whole, part, {"is_fake": 2}, {"mask_area_ratio": 1.5}, {**part, "mask_path": None}, {**whole, "manipulation_level2": "bogus"}, {"operator": "paint"}, {"manipulation_level1": "x"})
    assert [len(r[0]) for r in df.select(M.violations()).collect()] == [0, 0, 0, 1, 1, 1, 2, 1, 1]


def test_jsonl_round_trip(spark, tmp_path):
    df = frame(spark, {"image_id": "a", "seed": 10_000_001, "explanation": {"visual_evidence": "é", "semantic_inconsistency": "", "manipulation_type": "t", "localization_description": "d"}}, {"image_id": "b"})
    path = str(tmp_path / "m")
    M.write_jsonl(df, path)
    M.append_jsonl(frame(spark, {"image_id": "c"}), path)
    assert sorted(r.image_id for r in M.read_jsonl(spark, path).collect()) == ["a", "b", "c"]
    assert M.merge(spark, [path, str(tmp_path / "none")]).count() == 3
    assert M.read_jsonl(spark, path).where("image_id = 'a'").first().explanation.visual_evidence == "é"
    bad = tmp_path / "bad.jsonl"
    bad.write_text('{"image_id": "x"}\n\n{"image_id": "y", "ima')
    with pytest.raises(Exception):
        M.read_jsonl(spark, str(bad)).collect()
    assert [r._corrupt is None for r in M.read_jsonl(spark, str(bad), audit=True).collect()] == [True, False]


def test_jsonl_is_small(spark, tmp_path):
    """What a manifest occupies is its values, not the names and nulls of each line."""
    one = frame(spark, {"prompt": "p", "explanation": None})
    df = one.drop("image_id", "seed").crossJoin(spark.range(5000).selectExpr("concat('i', id) as image_id", "id as seed")).select(*M.FIELDS)
    path = tmp_path / "m"
    M.write_jsonl(df, str(path))
    M.append_jsonl(df, str(path))
    lines = spark.read.text(str(path))
    assert lines.count() == 10_000 and all(set(json.loads(r.value)) == set(M.FIELDS) for r in lines.limit(50).collect())
    plain = lines.selectExpr("sum(octet_length(value) + 1)").first()[0]
    assert sum(f.stat().st_size for f in path.iterdir()) < plain / 10
    back = M.merge(spark, [str(path), str(tmp_path / "none")])
    assert back.exceptAll(df.unionByName(df)).isEmpty() and back.count() == 10_000


def test_round_trip_leaves_no_files(spark):
    more.manifest_round_trip(spark, "/root/testdata/sf0.001").collect()
    shared = spark._jvm.org.apache.hadoop.fs.Path(spark.sparkContext._jsc.sc().getCheckpointDir().get())
    left = shared.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(shared)
    assert not [f for f in left if f.getPath().getName().startswith("round-trip-")]


def test_split(spark):
    rows = [{"image_id": f"{kind}{i}", "real_image_path": f"base/{kind}{i // 2}.png", "is_fake": fake, "postprocess": {**POST, "jpeg_quality": "70"} if i % 2 and fake else POST} for kind, fake in (("r", 0), ("f", 1)) for i in range(80)]
    rows += [{"image_id": "g", "is_fake": 1, "generator_name": "ideogram", "image_path": "g.png"}, {"image_id": "l", "is_fake": 1, "manipulation_level3": "text_editing", "image_path": "l.png"}, {"image_id": "s", "source_dataset": "Places", "image_path": "s.png"}]
    out = split.assign_splits(frame(spark, *rows), ["ideogram"], ["text_editing"], ["Places"])
    got = {r.image_id: r.split for r in out.collect()}
    assert (got["g"], got["l"], got["s"]) == ("test_b", "test_c", "test_d")
    assert set(got.values()) <= set(M.SPLITS) and "test_e" in got.values()
    assert all(got[f"r{i}"] == got[f"r{i + 1}"] for i in range(0, 80, 2))
    again = {r.image_id: r.split for r in split.assign_splits(frame(spark, *rows).repartition(3), ["ideogram"], ["text_editing"], ["Places"]).collect()}
    assert again == got
    assert split.leak_origin(out.where("split <> 'test_e'")).count() == 0


def test_leakage(spark):
    df = frame(spark, {"split": "train", "real_image_path": "b/x.png", "prompt": "", "seed": 1, "generator_name": "g", "source_dataset": "CASIA"}, {"split": "test_b", "real_image_path": "b/x.png", "prompt": "", "seed": 1, "generator_name": "g"})
    assert sorted((r.rule, r.leaks, r.examples) for r in split.check_leakage(df).collect()) == [("benchmark", 1, ["CASIA"]), ("generator", 1, ["g"]), ("origin", 1, ["x"]), ("prompt_seed", 1, ["1|"])]


def test_format_and_chain_rules(spark):
    df = frame(spark, {"split": "train"}, {"split": "train", "image_path": "a.jpg"}, {"split": "val", "image_path": "b.jpg", "postprocess": {**POST, "noise": "s5"}}, {"split": "val", "image_path": "c.jpg", "io_chain": "legacy"})
    assert found(rules.v1(df)) == [("train", ".jpg", 1)]
    df = frame(spark, {"split": "train", "io_chain": "decode>rs256>png"}, {"split": "train", "is_fake": 1, "io_chain": "gen:a>rs512>png"}, {"split": "val", "io_chain": "decode>rs256>png"}, {"split": "train", "io_chain": "legacy"})
    assert found(rules.v2(df)) == [("train", "rs256>png", 1), ("train", "rs512>png", 1)]


def test_row_rules(spark):
    df = frame(spark, {"operator": "inpaint"}, {"operator": "inpaint", "compositing": "overlay"}, {"operator": "outpaint", "compositing": "paste_feather"}, {"sample_kind": "bogus"}, {"operator": "outpaint", "compositing": "paste_feather", "feather_px": 8})
    assert found(rules.v3(df)) == [(None, "compositing missing", 1), (None, "compositing:overlay", 1), (None, "feather_px missing", 1), (None, "kind:bogus", 1)]
    assert found(rules.v5(frame(spark, {}, {"io_chain": "legacy"}, {"io_chain": "png"}))) == [(None, "legacy", 1), (None, "missing", 1)]
    df = frame(spark, *[{"operator": "instruct_edit", "op_params": p} for p in ("{", "{}", '{"image_guidance_scale": null}', None, "[]")])
    assert found(rules.v6(df)) == [(None, "key missing", 1), (None, "not an object", 3)]


def test_ratio_rule(spark):
    real = [{"split": "train", "sample_kind": "real"}] * 10
    rt = {"split": "train", "sample_kind": "real_vae_rt"}
    assert found(rules.v4(frame(spark, *real), profile="run")) == [("train", "0/10", 0)]
    assert found(rules.v4(frame(spark, *real))) == []
    assert found(rules.v4(frame(spark, *real, rt, rt))) == []
    assert found(rules.v4(frame(spark, *real, *[rt] * 10))) == [("train", "10/10", 10)]
    assert found(rules.v4(frame(spark, *real[:5], *[rt] * 5))) == []


def test_pairs(spark):
    pair = {"probe_group": "compositing_pair", "seed": 1, "real_image_path": "b", "generator_name": "g"}
    a, b = {**pair, "compositing": "none"}, {**pair, "compositing": "paste_feather"}
    df = frame(spark, *[{**r, "pair_id": "ok"} for r in (a, b)], {**a, "pair_id": "single"}, {**a, "pair_id": "seed"}, {**b, "pair_id": "seed", "seed": None}, {**a, "pair_id": "gen"}, {**b, "pair_id": "gen", "generator_name": "h"}, {**a, "pair_id": "comp"}, {**a, "pair_id": "comp"})
    assert [k for _, k, _ in found(rules.v7(df))] == ["comp:compositing", "gen:generator_name", "seed:seed", "single:count"]


def test_base_rule(spark):
    df = frame(spark, {"image_id": "m", "split": "test_a", "base_id": "b"}, {"image_id": "d", "split": "test_e", "base_id": "b", "postprocess_of": "m"}, {"image_id": "n", "split": "train", "base_id": "c"}, {"image_id": "o", "split": None, "base_id": "c"}, {"image_id": "p", "split": "val", "postprocess_of": "n"}, {"image_id": "q", "split": "val", "postprocess_of": "gone"})
    assert found(rules.v8(df)) == [(None, "base:c", 2), ("val", "mother:train", 1)]


def test_holdout_nuisance_and_area_rules(spark):
    df = frame(spark, {"split": "train", "generator_name": "h", "generator_family": "x"}, {"split": "val", "generator_name": "y", "generator_family": "h"}, {"split": "test_b", "generator_name": "h"})
    assert [s for s, _, _ in found(rules.v9(df, ["h"]))] == ["train", "val"]
    edit = {"is_fake": 1, "io_chain": "decode>edit:x>png", "split": "train"}
    good = '{"cfg_scale": 7.5, "steps": 30}'
    df = frame(spark, {**edit, "op_params": good}, {**edit, "op_params": '{"cfg_scale": "7.5", "steps": 30}'}, {**edit, "op_params": None}, {**edit, "generator_family": "non_diffusion"}, {**edit, "generator_name": "manual-web-edit"}, {**edit, "is_fake": 0})
    assert found(rules.v11(df)) == [(None, "not recorded", 2)]
    assert rules.v11(df, 2).where("key = 'cfg7.5/st30'").count() == 1
    df = frame(spark, {"operator": "inpaint", "mask_area_ratio": 0.1}, {"operator": "inpaint", "mask_area_ratio": 0.9}, {"operator": "inpaint"}, {"operator": "img2img"})
    assert found(rules.v12(df, 1)) == [(None, "bucket 0", 0), (None, "bucket 2", 0), (None, "bucket 3", 0), (None, "no ratio", 1)]


def test_statistics(spark):
    given = ['{"cfg_scale": 7.5, "steps": 30}'] * 2 + ['{"cfg_scale": 5.0, "steps": 50}', None, '{"oops"', '{"oops": 1, "steps": 30}']
    df = frame(spark, *[{"op_params": p} for p in given], {"mask_area_ratio": 0.1}, {"mask_area_ratio": 0.9}, {"mask_path": "m", "is_fake": 1})
    assert {r.cell: r.n for r in stats.by_nuisance_cell(df).collect()} == {"cfg7.5/st30": 2, "cfg5/st50": 1}
    assert {r.bucket: r.n for r in stats.by_area_bucket(df).collect()} == {"b1": 1, "b4": 1}
    assert tuple(stats.totals(df).first()) == (9, 8, 1, 1)
    assert {(r.field, r.value): r.n for r in stats.frequencies(df).collect()} == {("task_type", "real_pristine"): 9}


def test_empty_manifest(spark):
    df = spark.createDataFrame([], M.SCHEMA)
    assert rules.check_all(df, "run", ["h"], "op").count() == 0
    assert split.assign_splits(df, ["g"]).count() == 0 and stats.totals(df).first().total == 0
    assert split.check_leakage(df.withColumn("split", F.lit("train"))).count() == 0
