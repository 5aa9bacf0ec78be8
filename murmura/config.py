"""Settings of an evaluation: defaults, and a JSON file's over them. Unknown names and values out of range are errors."""

from __future__ import annotations

import copy
import json
import tomllib

#: The defaults.
DEFAULTS = {
    "track": "A",
    "wer": {"aggregation": "corpus"},
    "nvpa": {"tolerance": "1", "threshold_scale": 1.0, "min_window": 0.2, "max_window": 3.0, "unreliable_policy": "miss", "shuffle_reps": 50},
    "bootstrap": {"n_boot": 2000, "alpha": 0.05, "seed": 0, "min_n": 10},
    "human": {"subset_size": 100, "seed": 0, "rare_type_share": 0.05, "max_rare_fraction": 0.5, "n_gt_anchors": 5, "n_degraded_anchors": 5, "degrade_snr_db": 5.0, "anchor_gt_min": 3.0, "anchor_gap_min": 0.5, "exclude_flagged": True, "auto_on_subset": True},
    "ss": {"ref_mode": "centroid", "max_reference_clips": None},
}
#: The preset under which placement counts an event at its gap or one word later, with lower thresholds.
PRESETS = {"late": {"nvpa": {"tolerance": "0:1", "threshold_scale": 0.75}}}
CHOICES = {("track",): ("A", "B"), ("wer", "aggregation"): ("corpus", "sample_mean"), ("nvpa", "unreliable_policy"): ("miss", "exclude"), ("ss", "ref_mode"): ("centroid", "mean_cosine")}
RANGES = {("nvpa", "threshold_scale"): (0, float("inf")), ("bootstrap", "alpha"): (0, 1), ("human", "rare_type_share"): (0, 1), ("human", "max_rare_fraction"): (0, 1)}


def merged(base: dict, more: dict, place: str = "") -> dict:
    out = copy.deepcopy(base)
    for k, v in more.items():
        if k not in base:
            raise ValueError(f"unknown setting: {place}{k}")
        out[k] = merged(base[k], v, f"{place}{k}.") if isinstance(base[k], dict) else v
    return out


def of(path: tuple, settings: dict):
    for k in path:
        settings = settings[k]
    return settings


def settings(more: dict | None = None, preset: str | None = None) -> dict:
    out = merged(merged(DEFAULTS, PRESETS[preset] if preset else {}), more or {})
    for path, allowed in CHOICES.items():
        if of(path, out) not in allowed:
            raise ValueError(f"{'.'.join(path)} is none of {', '.join(allowed)}")
    for path, (low, high) in RANGES.items():
        if not low <= of(path, out) <= high:
            raise ValueError(f"{'.'.join(path)} is out of range")
    return out


def load(path: str | None) -> dict:
    if path is None:
        return settings()
    with open(path, "rb") as f:
        return settings(decoded(f.read(), path))


def decoded(raw: bytes, path: str) -> dict:
    """What a file says, by its ending: TOML, YAML (where a library for it is installed) or JSON."""
    kind = path.rsplit(".", 1)[-1].lower()
    if kind == "toml":
        return tomllib.loads(raw.decode())
    if kind in ("yaml", "yml"):
        try:
            import yaml
        except ImportError as e:
            raise ValueError("no library for YAML is installed: use JSON or TOML") from e
        return yaml.safe_load(raw) or {}
    return json.loads(raw)
