"""Parameters of a study, from TOML; unknown keys are ignored, missing ones take their defaults."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field, fields


@dataclass
class Decomposition:
    num_modes: int = 10
    alpha: float = 1000.0
    tolerance: float = 1e-8
    tau: float = 1e-3
    max_iterations: int = 500
    init: str = "exponential"
    noise_channels: int = 1
    noise_std: float = 0.8
    seed: int = 417


@dataclass
class Classification:
    k: int = 3
    metric: str = "cosine"
    trees: int = 100
    pca: list[int] = field(default_factory=list)
    seed: int = 42


@dataclass
class Groups:
    permutations: int = 10_000
    primary_t: float = 3.1
    seed: int = 20_260


@dataclass
class Study:
    sampling_rate: float = 1.25
    hht: Decomposition = field(default_factory=Decomposition)
    classification: Classification = field(default_factory=Classification)
    fc: Groups = field(default_factory=Groups)


def _fill(kind, values: dict):
    known = {f.name: f for f in fields(kind)}
    out = {}
    for key, value in values.items():
        if key in known:
            default = getattr(kind(), key)
            out[key] = _fill(type(default), value) if isinstance(value, dict) and hasattr(default, "__dataclass_fields__") else value
    return kind(**out)


def load(text: str) -> Study:
    return _fill(Study, tomllib.loads(text))


def selection_fingerprint(name: str, cortical: list[str], subcortical: list[str], networks: list[str] = (), stratified: bool = False) -> str:
    """name:cortical|subcortical[|net=...][|strat=1], in the order given, networks sorted."""
    parts = [f"{name}:{','.join(cortical)}", ",".join(subcortical)]
    if networks:
        parts.append(f"net={','.join(sorted(networks))}")
    if stratified:
        parts.append("strat=1")
    return "|".join(parts)


def result_directory(base: str, name: str = "", networks: list[str] = ()) -> str:
    """base, or its folder of the selection: name[__net-a_b], networks sorted."""
    if not name:
        return base
    return f"{base}/{name}" + (f"__net-{'_'.join(sorted(networks))}" if networks else "")
