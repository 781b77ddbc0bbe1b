"""Settings of the engine: defaults, or a JSON or YAML file, loaded once for each path."""

from __future__ import annotations

import functools
import json
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Settings:
    abs_tol: float = 1.0
    rel_tol: float = 0.005
    approve_threshold: float = 1.0
    item_name_threshold: float = 0.6
    price_tolerance: float = 0.5
    line_overlap: float = 0.5
    gold: str = "data/gold"
    ocr: str = "data/ocr"
    predictions: str = "results/preds"


@functools.cache
def load(path: str | None = None) -> Settings:
    """Unknown keys are an error; keys that the file lacks keep their defaults, and so does an empty file. YAML needs the yaml package."""
    if path is None:
        return Settings()
    with open(path, encoding="utf-8") as f:
        if path.endswith((".yaml", ".yml")):
            import yaml

            given = yaml.safe_load(f) or {}
        else:
            given = json.load(f)
    unknown = given.keys() - {x.name for x in fields(Settings)}
    if unknown:
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    return Settings(**given)
