"""Plug-ins that make pixels: interfaces, a registry by kind and backend, and stand-ins that need no model.

A plug-in works on one image (uint8 array). Row generation (operators/builders.py) decides what is made, with which
seed and parameters; a task then calls the plug-in for each row."""

from __future__ import annotations

import hashlib
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator

import numpy as np

from sievework.functions import pixels as P

Array = np.ndarray


class ImageSource(ABC):
    @abstractmethod
    def iter_images(self, n: int) -> Iterator[tuple[Array, dict]]: ...


class WholeImageGenerator(ABC):
    @abstractmethod
    def generate(self, prompt: str, params: dict) -> tuple[Array, dict]: ...


class Inpainter(ABC):
    @abstractmethod
    def inpaint(self, image: Array, mask: Array, prompt: str, params: dict) -> tuple[Array, dict]: ...


class Segmenter(ABC):
    @abstractmethod
    def propose_masks(self, image: Array, k: int) -> list[Array]: ...


class Explainer(ABC):
    @abstractmethod
    def explain(self, image: Array, mask: Array | None, context: dict) -> dict: ...


class Img2ImgGenerator(ABC):
    @abstractmethod
    def img2img(self, image: Array, prompt: str, strength: float, params: dict) -> tuple[Array, dict]: ...


class VaeRoundtrip(ABC):
    name = "none"

    @abstractmethod
    def roundtrip(self, image: Array) -> Array: ...


class ResidualExtractor(ABC):
    @abstractmethod
    def residual_stack(self, image: Array) -> Array: ...

    def profile(self, image: Array) -> Array:
        return P.profile(self.residual_stack(image))

    def residual_map(self, image: Array) -> Array:
        return self.residual_stack(image).mean(0)

    def detection_score(self, image: Array) -> float:
        return P.detection_score(self.residual_stack(image))


def number(text: str) -> int:
    return int.from_bytes(hashlib.sha1(text.encode()).digest()[:4], "big")


def seeded(seed: int, prompt: str) -> np.random.Generator:
    return np.random.default_rng((seed + number(prompt)) & 0x7FFFFFFF)


class Named:
    def __init__(self, name: str = "stand-in", family: str = "diffusion", seed: int = 0):
        self.name, self.family, self.seed = name, family, seed

    def record(self, params: dict, **more) -> dict:
        return {"generator_name": self.name, "generator_family": self.family, "seed": int(params.get("seed", 0)), **more}


class MockSource(Named, ImageSource):
    def iter_images(self, n: int) -> Iterator[tuple[Array, dict]]:
        from sievework.sources.images import DATASETS

        for i in range(n):
            yield P.synthetic(np.random.default_rng(self.seed + i), 256, 256), {"source_dataset": DATASETS[i % len(DATASETS)], "license": "research-only"}


class MockGenerator(Named, WholeImageGenerator):
    def generate(self, prompt: str, params: dict) -> tuple[Array, dict]:
        rng = seeded(int(params.get("seed", 0)) * 1_000_003, prompt)
        size = int(params.get("height", 256)), int(params.get("width", 256))
        return P.synthetic(rng, *size), self.record(params, steps=int(params.get("steps", 30)), cfg_scale=float(params.get("cfg_scale", 7.5)), sampler=params.get("sampler", "DPM++ 2M"))


class MockRoundtrip(Named, VaeRoundtrip):
    def __init__(self, name: str = "mock", family: str = "diffusion", seed: int = 0):
        super().__init__(name, family, seed)

    def roundtrip(self, image: Array) -> Array:
        soft = P.gaussian(image, 0.6)
        return np.clip(soft + (image - soft) / 3, 0, 255).astype(np.uint8)


class MockInpainter(Named, Inpainter):
    def inpaint(self, image: Array, mask: Array, prompt: str, params: dict) -> tuple[Array, dict]:
        out, m = image.copy(), P.on(mask)
        out[m] = seeded(int(params.get("seed", 0)), prompt).integers(0, 256, 3)
        edge = P.on(P.dilate(mask)) & ~P.on(P.erode(mask))
        out[edge] = P.blur(out, 5)[edge]
        return MockRoundtrip().roundtrip(out), self.record(params)


class MockSegmenter(Named, Segmenter):
    def propose_masks(self, image: Array, k: int) -> list[Array]:
        first = self.seed + int.from_bytes(P.content_hash(image)[:4], "big")
        return [P.rect_mask(np.random.default_rng((first + j) & 0x7FFFFFFF), *image.shape[:2], share) for j, share in enumerate(np.linspace(0.02, 0.45, max(1, k)).tolist())][:k]


class MockExplainer(Named, Explainer):
    def explain(self, image: Array, mask: Array | None, context: dict) -> dict:
        kind, where = context.get("manipulation_level3", "local editing"), context.get("region", "the masked region")
        return {"visual_evidence": "Smooth edges that do not match the surroundings.", "semantic_inconsistency": f"The content of {where} does not fit the scene.", "manipulation_type": kind, "localization_description": f"Edited at {where}."}


class MockImg2Img(Named, Img2ImgGenerator):
    def img2img(self, image: Array, prompt: str, strength: float, params: dict) -> tuple[Array, dict]:
        a = float(np.clip(strength, 0, 1))
        made = P.synthetic(seeded(int(params.get("seed", 0)), prompt), *image.shape[:2])
        return np.clip((1 - a) * image + a * made, 0, 255).astype(np.uint8), self.record(params, strength=a)


class MultiSigma(Named, ResidualExtractor):
    def residual_stack(self, image: Array) -> Array:
        return P.residual_stack(image)


KINDS = ("image_source", "whole_generator", "inpainter", "segmenter", "explainer", "img2img", "vae_rt", "extractor")
_FACTORIES: dict[tuple[str, str], Callable] = {
    ("image_source", "mock"): MockSource,
    ("whole_generator", "mock"): MockGenerator,
    ("inpainter", "mock"): MockInpainter,
    ("segmenter", "mock"): MockSegmenter,
    ("explainer", "mock"): MockExplainer,
    ("img2img", "mock"): MockImg2Img,
    ("vae_rt", "mock"): MockRoundtrip,
    ("extractor", "multisigma"): MultiSigma,
}
_MADE: dict[tuple, object] = {}


def register(kind: str, backend: str, factory: Callable) -> None:
    """Make a backend known: factory(name=, family=, seed=) returns a plug-in of the kind."""
    if kind not in KINDS:
        raise ValueError(f"kind must be one of {', '.join(KINDS)}")
    _FACTORIES[kind, backend] = factory


def get(kind: str, backend: str = "mock", **options):
    """The plug-in; one per process and set of options, as models are slow to load."""
    if (kind, backend) not in _FACTORIES:
        known = sorted(b for k, b in _FACTORIES if k == kind)
        raise NotImplementedError(f"no {kind} of backend {backend!r}; there are: {', '.join(known) or 'none'}")
    key = (kind, backend, tuple(sorted(options.items())))
    if key not in _MADE:
        _MADE[key] = _FACTORIES[kind, backend](**options)
    return _MADE[key]
