"""Layered configuration and library defaults."""

from __future__ import annotations

import copy
import json
from pathlib import Path
from typing import Any

#: Fixed values.
DEFAULTS: dict[str, Any] = {
    "discovery": {"extensions": [".md", ".txt", ".pdf"], "max_bytes": 52_428_800, "ignored": [".git", ".obsidian", ".trash", "__pycache__", "node_modules", ".venv"]},
    "parsing": {"unicode_form": "NFC", "max_newlines": 3, "min_chars": 10, "pdf_pages": 500, "pdf_chars": 5_000_000},
    "segmentation": {"min_chars": 3, "max_chars": 2000, "separator": " > "},
    "claims": {"max_per_sentence": 10},
    "retrieval": {"top_k": 50, "threshold": 0.75, "dense_above": 20, "isolated_upto": 1, "max_pairs": 100_000},
    "resolver": {"nli_threshold": 0.80, "neutrality_threshold": 0.60, "contradiction_margin": 0.0, "entailment_margin": 0.0, "min_confidence": 0.50, "relatedness": 0.03, "specificity_margin": 3.0},
    "graph": {"hub_multiplier": 2.0, "foundational_centrality": 0.5, "foundational_in": 2, "hub_in": 3, "refines_out": 2, "peripheral_degree": 1, "min_delta_days": 1.0},
    "query": {"page_max": 1000, "page_default": 50, "cache_size": 256, "max_depth": 5},
}


def deep_merge(base: dict, override: dict) -> dict:
    """override laid over base: dictionaries merge, everything else replaces."""
    out = copy.deepcopy(base)
    for key, value in override.items():
        out[key] = deep_merge(out[key], value) if isinstance(value, dict) and isinstance(out.get(key), dict) else copy.deepcopy(value)
    return out


def load(*paths: str | Path, defaults: dict | None = None) -> dict:
    """Defaults with JSON files laid over them in order; missing files are skipped."""
    out = copy.deepcopy(DEFAULTS if defaults is None else defaults)
    for path in paths:
        p = Path(path)
        if p.exists():
            out = deep_merge(out, json.loads(p.read_text()))
    return out


def get(config: dict, dotted: str, default: Any = None) -> Any:
    """The value at a dotted path."""
    at: Any = config
    for part in dotted.split("."):
        if not isinstance(at, dict) or part not in at:
            return default
        at = at[part]
    return at
