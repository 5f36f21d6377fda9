"""Command line: build a data set or a probe, its statistics, validation, a viewer page, gates.

    python -m sievework.cli stats --path manifest.jsonl
    python -m sievework.cli validate-manifest --path manifest.jsonl --profile run --split-config split.yaml
    python -m sievework.cli run --config run.yaml --out folder
    python -m sievework.cli probe --config probe.yaml --n-base 8
    python -m sievework.cli viewer --run folder
    python -m sievework.cli gates --run folder --probe folder
"""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.errors import PySparkException
from pyspark.sql import SparkSession

from sievework import config as C
from sievework import reports
from sievework.sources import images, manifest


def session() -> SparkSession:
    return SparkSession.getActiveSession() or SparkSession.builder.appName("sievework").getOrCreate()


def shown(value) -> None:
    print(json.dumps(value, ensure_ascii=False, indent=2, default=str))


def stats(args) -> int:
    shown(reports.statistics(manifest.read_jsonl(session(), args.path)))
    return 0


def validate(args) -> int:
    if not os.path.exists(args.path):
        print(f"no manifest at {args.path}", file=sys.stderr)
        return 2
    df = manifest.read_jsonl(session(), args.path, audit=True).cache()
    try:
        from pyspark.sql import functions as F

        bad = df.select("image_id", F.when(F.col("_corrupt").isNotNull(), F.array(F.lit("no record"))).otherwise(manifest.violations()).alias("problems")).where("size(problems) > 0")
        first = bad.limit(20).collect()
        if first:
            print("\n".join(f"{r['image_id']}: {', '.join(r['problems'])}" for r in first), file=sys.stderr)
            return 1
        split = C.read_yaml(args.split_config) if os.path.exists(args.split_config) else {}
        options = {"profile": args.profile, "holdout": tuple(split.get("holdout_generators") or ()), "testc_operator": split.get("testc_holdout") or None}
        found, ran = reports.validation(df.drop("_corrupt"), **options)
        skipped = [f"V{i}" for i in range(1, 13) if f"V{i}" not in ran]
        if skipped:
            print(f"not run: {', '.join(skipped)}")
        for v in found:
            print(f"{v['rule']}: split={v['split']} {v['key']} ({v['n']})", file=sys.stderr)
        if found:
            return 1
        print(f"OK: {df.count()} rows, {', '.join(ran)}")
        return 0
    except PySparkException as e:
        print(f"manifest cannot be read: {e}", file=sys.stderr)
        return 1
    finally:
        df.unpersist()


def run(args) -> int:
    from sievework.plans.build import build

    settings = C.load_config(args.config)
    settings.out_dir = args.out or settings.out_dir
    shown(build(session(), settings))
    return 0


def probe(args) -> int:
    from sievework.plans.build import build_probe

    data = C.read_yaml(args.config)
    made = C.load_generators(data["generators_config"])
    shown(build_probe(session(), args.out or data.get("out_dir", "data/probe"), made["img2img"], made["inpainters"], n_base=args.n_base or int(data.get("n_base", 40)), strengths=data.get("strengths") or [round(0.1 * i, 1) for i in range(1, 10)],
                      operators=data.get("operators") or ["img2img", "inpaint", "outpaint", "object_replacement", "background_editing"], holdout=tuple(data.get("holdout_generators") or ()), seed=int(data.get("seed", 0)), cfg=data.get("cfg_grid") or (),
                      steps=data.get("steps_grid") or (), pairs=int(data.get("compositing_pairs", 0)), backend=data.get("backend", "mock")))
    return 0


def viewer(args) -> int:
    path = os.path.join(args.run, "manifest.jsonl")
    if not os.path.exists(path):
        print(f"no manifest.jsonl in {args.run}", file=sys.stderr)
        return 2
    out = args.out or os.path.join(args.run, "viewer.html")
    n = reports.viewer(manifest.read_jsonl(session(), path), images.scan(session(), args.run), out, args.max or 500)
    print(f"{out}: {n} rows")
    return 0


def gates(args) -> int:
    from sievework.plans.build import run_gates

    found = run_gates(session(), args.run, args.probe)
    reports.write_json(found, args.out)
    shown(found)
    return 0


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="sievework")
    sub = parser.add_subparsers(dest="command", required=True)

    def command(name: str, f, *arguments: tuple[str, dict]) -> None:
        p = sub.add_parser(name)
        for flag, options in arguments:
            p.add_argument(flag, **options)
        p.set_defaults(call=f)

    need, text, number = {"required": True}, {"default": None}, {"type": int, "default": None}
    command("run", run, ("--config", need), ("--out", text))
    command("stats", stats, ("--path", need))
    command("validate-manifest", validate, ("--path", need), ("--profile", {"default": "auto", "choices": ["auto", "run"]}), ("--split-config", {"default": "configs/split.yaml"}))
    command("viewer", viewer, ("--run", need), ("--out", text), ("--max", number))
    command("probe", probe, ("--config", need), ("--out", text), ("--n-base", number))
    command("gates", gates, ("--run", need), ("--probe", need), ("--out", {"default": "checking_report.json"}))
    args = parser.parse_args(argv)
    return args.call(args)


if __name__ == "__main__":
    raise SystemExit(main())
