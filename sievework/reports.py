"""Reports: statistics as JSON and Markdown, a viewer page, and pair checks over stored images."""

from __future__ import annotations

import base64
import json
from collections.abc import Sequence
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.functions import pixels as P
from sievework.operators import rules, stats, tables
from sievework.sources import images


def statistics(df: DataFrame) -> dict:
    """All statistics of a manifest. Tables in it are vocabularies, not rows of data."""
    total = stats.totals(df).first().asDict()
    out: dict = dict(total)
    for r in stats.frequencies(df).collect():
        out.setdefault(f"by_{r['field']}", {})[r["value"]] = r["n"]
    for r in stats.chain_by_split(df).collect():
        out.setdefault("chain_by_split", {}).setdefault(r["split"], {})[r["chain"]] = {"real": r["real"], "fake": r["fake"]}
    out["by_nuisance_cell"] = {r["cell"]: r["n"] for r in stats.by_nuisance_cell(df).collect()}
    out["by_area_bucket"] = {r["bucket"]: r["n"] for r in stats.by_area_bucket(df).collect()}
    return out


def write_json(value: dict, path: str) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(value, ensure_ascii=False, indent=2, sort_keys=True, default=str), encoding="utf-8")


def markdown(rows: DataFrame, title: str, most: int = 1000) -> str:
    """A result table (at most `most` rows: the report's limit) as Markdown."""
    shown = lambda v: "" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v).replace("|", "\\|")
    lines = [f"# {title}", "", "| " + " | ".join(rows.columns) + " |", "|" + "---|" * len(rows.columns)]
    return "\n".join(lines + ["| " + " | ".join(map(shown, r)) + " |" for r in rows.limit(most).collect()]) + "\n"


def write_once(text: str, path: str) -> None:
    """A report of a one-time evaluation: fails if it is there already."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    with open(path, "x", encoding="utf-8") as f:
        f.write(text)


PAGE = """<!doctype html><html><head><meta charset="utf-8"><title>Data set</title><style>
body{{font-family:sans-serif;margin:1em}} figure{{display:inline-block;width:230px;margin:4px;vertical-align:top;font-size:12px}} img{{max-width:224px}}
</style></head><body><p><input id="q" placeholder="id or prompt"> <select id="k"><option value="">all<option value="0">real<option value="1">fake</select> {facets} <span id="n"></span></p><div id="out"></div>
<script>const rows={rows};
const picks=[...document.querySelectorAll("select[data-f]")];
function show(){{const q=document.getElementById("q").value.toLowerCase(),k=document.getElementById("k").value;
const hit=rows.filter(r=>(!k||String(r.is_fake)===k)&&(!q||((r.image_id||"")+" "+(r.prompt||"")).toLowerCase().includes(q))&&picks.every(p=>!p.value||r[p.dataset.f]===p.value));
document.getElementById("n").textContent=hit.length;const out=document.getElementById("out");out.replaceChildren();
for(const r of hit){{const f=document.createElement("figure");if(r.picture){{const i=document.createElement("img");i.src="data:image/png;base64,"+r.picture;f.append(i)}}
const c=document.createElement("figcaption");c.textContent=[r.image_id,r.split,r.task_type,r.generator_name,r.operator].filter(Boolean).join(" | ");f.append(c);out.append(f)}}}}
document.querySelectorAll("input,select").forEach(e=>e.addEventListener("input",show));show();</script></body></html>"""


def viewer(df: DataFrame, files: DataFrame | None, path: str, most: int = 500, order: Sequence[str] = ("image_id",)) -> int:
    """Writes a page with the first `most` rows (the page's limit), their thumbnails with masks laid over them, and
    filters; returns how many rows it shows. Rows whose image cannot be read are left out. files: name, data."""
    first = tables.head(df, most, order)
    wanted = [c for c in ("image_id", "is_fake", "split", "task_type", "manipulation_level1", "manipulation_level3", "generator_name", "operator", "prompt") if c in df.columns]
    pictures: dict[str, str] = {}
    if files is not None:
        both = images.with_pixels(images.with_pixels(first, files), files, "mask_path", "mask")
        rows = both.select(*wanted, "data", "mask").collect()
        for r in rows:
            img = P.decode_png(bytes(r["data"])) if r["data"] is not None else None
            if img is None:
                continue
            mask = P.decode_png(bytes(r["mask"])) if r["mask"] is not None else None
            img = P.as_rgb(img)
            if mask is not None and mask.shape[:2] == img.shape[:2]:
                img = P.overlay(img, P.grey(P.as_rgb(mask)))
            pictures[r["image_id"]] = base64.b64encode(P.encode_png(P.thumbnail(img))).decode()
        rows = [r for r in rows if r["image_id"] in pictures]
    else:
        rows = first.select(*wanted).collect()
    records = [{c: r[c] for c in wanted} | {"picture": pictures.get(r["image_id"])} for r in rows]
    options = ""
    for f in (c for c in tables.FACETS if c in wanted):
        values = sorted({str(r[f]) for r in records if r[f]})
        options += f'<select data-f="{f}"><option value="">{f}' + "".join(f"<option>{v.replace('&', '&amp;').replace('<', '&lt;')}" for v in values) + "</select> "
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(PAGE.format(rows=json.dumps(records, ensure_ascii=False).replace("<", "\\u003c"), facets=options), encoding="utf-8")
    return len(records)


def pair_problems(df: DataFrame, files: DataFrame, band: int = 8, least_change: float = 0.15) -> DataFrame:
    """pair_id, image_id, problem of compositing pairs: two rows each; a blended row equals its base outside the widened mask,
    and a row stored as made differs from it almost everywhere. files: name, data."""
    rows = df.where("probe_group = 'compositing_pair'")
    count = rows.groupBy("pair_id").agg(F.count("*").alias("n"))
    wrong = count.where("n <> 2").select("pair_id", F.lit(None).cast("string").alias("image_id"), F.lit("not two rows").alias("problem"))
    whole = rows.join(count.where("n = 2").select("pair_id"), "pair_id")
    whole = images.with_pixels(images.with_pixels(images.with_pixels(whole, files), files, "real_image_path", "base"), files, "mask_path", "mask")

    def check(made: bytes | None, base: bytes | None, mask: bytes | None, mode: str | None, feather: int | None) -> str | None:
        img, was = (P.decode_png(bytes(x)) if x is not None else None for x in (made, base))
        if img is None or was is None or img.shape != was.shape:
            return "image or base missing"
        if mode == "paste_feather":
            m = P.decode_png(bytes(mask)) if mask is not None else None
            if m is None:
                return "mask missing"
            far = ~P.on(P.dilate(P.grey(P.as_rgb(m)), band * (feather or 8) + 1))
            return None if np.array_equal(img[far], was[far]) else "differs outside the mask"
        if mode == "none":
            return None if (img != was).mean() > least_change else "hardly differs"
        return "unknown compositing"

    @F.pandas_udf("string")
    def judged(made: pd.Series, base: pd.Series, mask: pd.Series, mode: pd.Series, feather: pd.Series) -> pd.Series:
        return pd.Series([check(a, b, c, d, None if pd.isna(e) else int(e)) for a, b, c, d, e in zip(made, base, mask, mode, feather, strict=True)], dtype=object)

    found = whole.select("pair_id", "image_id", judged("data", "base", "mask", "compositing", "feather_px").alias("problem")).where("problem is not null")
    return wrong.unionByName(found)


def validation(df: DataFrame, **options) -> tuple[list[dict], list[str]]:
    """The violations (one row for each rule, split and key: vocabularies and offenders, at most 1,000 shown) and the rules
    that ran."""
    run = options.get("profile") == "run"
    ran = [f"V{i}" for i in (1, 2, 3, 4)] + (["V5"] if run else []) + ["V6", "V7"] + (["V8"] if run else []) + (["V9"] if options.get("holdout") else [])
    ran += (["V10"] if run and options.get("testc_operator") else []) + (["V11", "V12"] if run else [])
    return [r.asDict() for r in rules.check_all(df, **options).orderBy("rule", "split", "key").limit(1000).collect()], ran
