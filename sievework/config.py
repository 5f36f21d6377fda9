"""Configuration: run settings, generators and prompt banks from YAML."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, fields
from pathlib import Path

import yaml
from pyspark.sql import Column
from pyspark.sql import functions as F

from sievework.functions.exprs import stable_hash

PROMPT_KINDS = ("img2img", "inpaint", "object", "background")


@dataclass(frozen=True)
class Generator:
    name: str
    family: str
    kind: str = ""


@dataclass
class Config:
    out_dir: str
    seed: int = 0
    backend: str = "mock"
    stages: dict = field(default_factory=dict)
    scales: dict = field(default_factory=lambda: {"d0": 40, "d1_per_generator": 3, "d2": 24, "d3": 12, "d4": 8})
    generators: Sequence[Generator] = ()
    inpainters: Sequence[Generator] = ()
    img2img: Sequence[Generator] = ()
    postprocess_prob: float = 0.5
    split_config: str = "configs/split.yaml"
    vae_rt_frac: float = 0.15
    compositing_feather_px: int = 8
    nuisance_cfg_grid: Sequence[float] = (5.0, 7.5, 10.0)
    nuisance_steps_grid: Sequence[int] = (30, 50)
    strength_range: tuple[float, float] = (0.1, 0.95)
    area_buckets: Sequence[float] = (0.05, 0.15, 0.35, 0.7)
    outpaint_border_fracs: Sequence[float] = (0.125, 0.25)
    resolution_groups: Mapping[int, Sequence[str]] = field(default_factory=dict)
    prompt_bank: str = "configs/prompt_bank.yaml"
    grid_per_op: int = 0


def read_yaml(path: str) -> dict:
    return yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}


def load_generators(path: str) -> dict[str, list[Generator]]:
    data = read_yaml(path)
    return {k: [Generator(**g) for g in data.get(k, [])] for k in ("generators", "inpainters", "img2img")}


def load_config(path: str) -> Config:
    """The settings; what the file does not name keeps its default, and unknown names are ignored."""
    data = read_yaml(path)
    given = {f.name: data[f.name] for f in fields(Config) if f.name in data}
    if "generators_config" in data:
        given |= load_generators(data["generators_config"])
    given["resolution_groups"] = {int(k): list(v) for k, v in (given.get("resolution_groups") or {}).items()}
    given["strength_range"] = tuple(given.get("strength_range", (0.1, 0.95)))
    given["scales"] = {"d0": 40, "d1_per_generator": 3, "d2": 24, "d3": 12, "d4": 8} | (given.get("scales") or {})
    return Config(**given)


@dataclass(frozen=True)
class PromptBank:
    """Prompts by kind, and the version of the file they are from."""

    prompts: Mapping[str, Sequence[str]]
    version: str

    def pick(self, kind: str, key: Column) -> Column:
        """The kind's prompt for a key: the same key always has the same one."""
        return self._pick(kind, key, lambda p: p)

    def pick_json(self, kind: str, key: Column) -> Column:
        """The same prompt as a JSON string."""
        return self._pick(kind, key, lambda p: json.dumps(p, ensure_ascii=False))

    def _pick(self, kind: str, key: Column, shown) -> Column:
        found = list(self.prompts.get(kind) or ())
        if not found:
            raise ValueError(f"no prompts of kind {kind!r}")
        return F.element_at(F.array(*[F.lit(shown(p)) for p in found]), (stable_hash(key) % len(found) + 1).cast("int"))


def load_bank(path: str) -> PromptBank:
    data = read_yaml(path)
    missing = [k for k in PROMPT_KINDS if not isinstance(data.get(k), list) or not data[k]]
    if missing:
        raise ValueError(f"{path} has no prompts of kind {', '.join(missing)}")
    return PromptBank({k: data[k] for k in data if isinstance(data[k], list)}, hashlib.sha1(Path(path).read_bytes()).hexdigest()[:12])
