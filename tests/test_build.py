"""Command line, building, files and streams end to end, on a few pictures."""

import json

import pytest
from pyspark.sql import functions as F

from sievework import cli, reports
from sievework import config as C
from sievework.operators import builders as B
from sievework.sources import images, manifest
from sievework.streaming import ingest


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("built")
    (d / "gen.yaml").write_text("generators: [{name: a, family: diffusion, kind: whole}]\ninpainters: [{name: p1, family: f1, kind: inpaint}, {name: p2, family: f2, kind: inpaint}]\nimg2img: [{name: m1, family: f1, kind: edit}]\n")
    (d / "bank.yaml").write_text("img2img: [sea, 'a \"sign\"']\ninpaint: [fill]\nobject: [chair]\nbackground: [hill]\n")
    (d / "split.yaml").write_text("holdout_generators: [p2]\nholdout_domains: [Places]\n")
    (d / "run.yaml").write_text(f"out_dir: {d}/run\nseed: 3\ngenerators_config: {d}/gen.yaml\nstages: {{d0: true, d1: true, d2: true, d4: true, grid: true, postprocess: true, split: true}}\nscales: {{d0: 6, d1_per_generator: 1, d2: 3, d4: 2}}\ngrid_per_op: 2\nprompt_bank: {d}/bank.yaml\nsplit_config: {d}/split.yaml\n")
    (d / "probe.yaml").write_text(f"out_dir: {d}/probe\ngenerators_config: {d}/gen.yaml\nn_base: 2\nstrengths: [0.2, 0.8]\noperators: [img2img, inpaint]\nholdout_generators: [p2]\ncompositing_pairs: 2\n")
    assert cli.main(["run", "--config", str(d / "run.yaml")]) == 0 and cli.main(["probe", "--config", str(d / "probe.yaml")]) == 0
    return d


def test_run(spark, made, capsys):
    run = str(made / "run")
    rows = manifest.read_jsonl(spark, f"{run}/manifest.jsonl")
    assert rows.where("is_fake = 0 and sample_kind = 'real'").count() == 6 and rows.where("size(coalesce(array(1), array())) = 0").count() == 0
    assert rows.select(F.explode(manifest.violations())).count() == 0 and rows.select("image_id").distinct().count() == rows.count()
    files = {r.name for r in images.scan(spark, run).select("name").collect()}
    paths = {p for r in rows.select("image_path", "mask_path").collect() for p in r if p}
    assert paths <= files and json.loads((made / "run" / "stats.json").read_text())["total"] == rows.count()
    assert cli.main(["validate-manifest", "--path", f"{run}/manifest.jsonl", "--split-config", str(made / "split.yaml")]) == 0
    assert cli.main(["stats", "--path", f"{run}/manifest.jsonl"]) == 0 and '"real"' in capsys.readouterr().out
    assert cli.main(["validate-manifest", "--path", f"{run}/none.jsonl"]) == 2 and cli.main(["viewer", "--run", str(made)]) == 2
    assert cli.main(["viewer", "--run", run, "--max", "4"]) == 0 and "data:image/png" in (made / "run" / "viewer.html").read_text()


def test_validate_tells_bad_lines(spark, tmp_path):
    path = tmp_path / "m.jsonl"
    path.write_text('{"image_id": "a", "image_path": "a.png", "is_fake": 2, "task_type": "real_pristine"}\n{"image_id": "b"')
    assert cli.main(["validate-manifest", "--path", str(path)]) == 1


def test_probe(spark, made):
    probe = str(made / "probe")
    rows = manifest.read_jsonl(spark, f"{probe}/manifest.jsonl")
    n = {r[0]: r[1] for r in rows.groupBy(F.coalesce("probe_group", "operator", "sample_kind")).count().collect()}
    assert n == {"real": 2, "img2img": 2 * 2 + 2, "inpaint": 2 * 2, "compositing_pair": 4}
    assert rows.where("init_timestep is not null and operator <> 'img2img'").count() == 0 and {r.split for r in rows.select("split").distinct().collect()} == {"train", "test_b", None}
    files = images.scan(spark, probe)
    assert reports.pair_problems(rows, files).count() == 0
    wrong = rows.withColumn("mask_path", F.lit("none.png"))
    assert {r.problem for r in reports.pair_problems(wrong, files).collect()} == {"mask missing"}
    assert reports.pair_problems(rows.where("compositing <> 'none'"), files).where("problem = 'not two rows'").count() == 2


def test_unreadable_images(spark, tmp_path):
    (tmp_path / "bad.png").write_bytes(b"no picture")
    (tmp_path / "note.txt").write_bytes(b"x")
    files = images.directory(spark, str(tmp_path))
    assert [r.problems for r in images.quality(files, ("name",)).collect()] == [["unreadable"]] and images.hashes(files, ("name",)).count() == 0


def test_real_rows_of_resolutions(spark):
    taken = spark.createDataFrame([("ab" * 20, 256, "s", "l")], "content string, height int, source_dataset string, license string")
    small, large = B.real_rows(taken, (512, 256)).orderBy("io_chain").collect()
    assert small.base_id == large.base_id == small.image_id and large.real_image_path == small.image_path and small.real_image_path is None
    assert B.real_rows(taken).first().image_id.startswith("real_")


def test_local_edit_masks(spark):
    pick = B.bucketed(F.array(*[F.struct(F.lit(r).alias("ratio")) for r in (0.02, 0.1, 0.4)]), (0.05, 0.15, 0.35, 0.7), F.col("salt"))
    df = spark.range(200).select(F.col("id").cast("string").alias("salt")).select(pick["ratio"].alias("r"))
    assert {r.r for r in df.distinct().collect()} == {0.02, 0.1, 0.4}


def test_config(tmp_path):
    (tmp_path / "c.yaml").write_text("out_dir: x\nresolution_groups: {256: [a], 512: [b]}\nunknown: 1\n")
    c = C.load_config(str(tmp_path / "c.yaml"))
    assert c.resolution_groups == {256: ["a"], 512: ["b"]} and c.scales["d2"] == 24 and c.strength_range == (0.1, 0.95)
    (tmp_path / "b.yaml").write_text("img2img: [a]\n")
    with pytest.raises(ValueError):
        C.load_bank(str(tmp_path / "b.yaml"))


def line(i, **more):
    return json.dumps({"image_id": f"i{i}", "image_path": "a.png", "is_fake": 0, "task_type": "real_pristine", "probe_group": f"g{i % 2}"} | more)


def test_ingest_resumes(spark, tmp_path):
    incoming, run = tmp_path / "in", str(tmp_path / "run")
    incoming.mkdir()
    (incoming / "1.json").write_text("\n".join([line(0), line(1), line(2, is_fake=2), '{"image_id": "tor']))
    ingest.ingest(spark, str(incoming), run).awaitTermination()
    (incoming / "2.json").write_text(line(3))
    for _ in range(2):  # the second start finds nothing new
        ingest.ingest(spark, str(incoming), run).awaitTermination()
    assert sorted(r.image_id for r in ingest.stored(spark, run).collect()) == ["i0", "i1", "i3"]
    assert sorted(len(r.problems) for r in ingest.rejected(spark, run).collect()) == [1, 1]
    assert {r.cell for r in spark.read.parquet(f"{run}/done").collect()} == {"g0", "g1"}


def test_driver_files(tmp_path):
    path = str(tmp_path / "run" / "m.jsonl")
    assert not ingest.repair_tail(path)
    for i in range(3):
        ingest.append_line(path, {"i": i, "t": "žluťoučký"})
    whole = open(path, "rb").read()
    assert not ingest.repair_tail(path)
    for cut, want in ((len(whole) - 1, whole), (len(whole) - 4, whole[: 2 * len(whole) // 3]), (len(whole) - 6, whole[: 2 * len(whole) // 3]), (5, b"")):
        open(path, "wb").write(whole[:cut])
        assert ingest.repair_tail(path) and open(path, "rb").read() == want and open(path + ".bak", "rb").read() == whole[:cut]
    cells = ["a/b c", "č 😀", "x"]
    ingest.mark_done(str(tmp_path), cells[1])
    assert ingest.is_done(str(tmp_path), cells[1]) and not ingest.is_done(str(tmp_path), "x") and ingest.not_done(str(tmp_path), cells) == ["a/b c", "x"] and ingest.not_done(str(tmp_path / "none"), cells) == cells


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([("a|b", 0.5, None)], "k string, v double, w string")
    assert reports.markdown(df, "T").splitlines()[-1] == "| a\\|b | 0.5000 |  |"
    reports.write_once("x", str(tmp_path / "r" / "x.md"))
    with pytest.raises(FileExistsError):
        reports.write_once("y", str(tmp_path / "r" / "x.md"))
