"""Configuration as a small YAML file: defaults for whatever is missing or broken, atomic saves, partial updates."""

from __future__ import annotations

import json
import os
import tempfile
from dataclasses import asdict, dataclass, field, fields

from mediaframe.sources.media import EXCLUDED_NAMES, EXCLUDED_SUFFIXES


@dataclass
class Config:
    exclude_dir_names: list[str] = field(default_factory=lambda: list(EXCLUDED_NAMES))
    exclude_suffixes: list[str] = field(default_factory=lambda: list(EXCLUDED_SUFFIXES))
    debounce_ms: int = 500
    auto_scan_on_change: bool = False
    sync_presets: list[dict] = field(default_factory=list)


def load(path: str) -> Config:
    """The file's values over the defaults; the defaults alone if it is missing or unreadable.

    Values are JSON, which is YAML; one ``name: value`` a line.
    """
    out = Config()
    known = {f.name for f in fields(Config)}
    try:
        with open(path, encoding="utf-8") as f:
            pairs = [line.split(":", 1) for line in f if ":" in line and not line.lstrip().startswith("#")]
        values = {k.strip(): json.loads(v) for k, v in pairs}
    except (OSError, ValueError):
        return out
    return merge(out, {k: v for k, v in values.items() if k in known})


def merge(config: Config, changes: dict) -> Config:
    """A copy with the changes; unknown names are an error, None leaves a value as it is."""
    return Config(**(asdict(config) | {k: v for k, v in changes.items() if v is not None}))


def save(config: Config, path: str) -> None:
    """Write beside the file, then rename over it."""
    folder = os.path.dirname(os.path.abspath(path))
    os.makedirs(folder, exist_ok=True)
    with tempfile.NamedTemporaryFile("w", dir=folder, delete=False, encoding="utf-8") as f:
        f.writelines(f"{k}: {json.dumps(v, ensure_ascii=False)}\n" for k, v in asdict(config).items())
    os.replace(f.name, path)


def save_preset(config: Config, preset: dict) -> Config:
    """Presets are told apart by id."""
    rest = [p for p in config.sync_presets if p.get("id") != preset.get("id")]
    return merge(config, {"sync_presets": [*rest, preset]})


def delete_preset(config: Config, preset_id: str) -> Config:
    return merge(config, {"sync_presets": [p for p in config.sync_presets if p.get("id") != preset_id]})
