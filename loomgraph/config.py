"""Settings from the environment and from a ``.env`` file that is found on the way up from a folder."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass
from pathlib import Path

HASH_MODES = ("mtime", "content")


@dataclass(frozen=True)
class Config:
    workspace: str = "."
    data_dir: str = ".loomgraph"
    hash_mode: str = "mtime"
    watch: bool = False


def read_env_file(start: str | Path) -> dict[str, str]:
    """The ``KEY=value`` lines of the nearest ``.env``; comments, quotes around values and ``export`` are dropped."""
    here = Path(start).resolve()
    for folder in (here, *here.parents):
        file = folder / ".env"
        if file.is_file():
            out = {}
            for line in file.read_text().splitlines():
                key, eq, value = line.strip().removeprefix("export ").partition("=")
                if eq and not key.startswith("#"):
                    out[key.strip()] = value.strip().strip("\"'")
            return out
    return {}


def from_env(env: Mapping[str, str] | None = None, start: str | Path = ".") -> Config:
    """Settings named ``LOOMGRAPH_*``; the environment wins over the file, an unknown hash mode is the default one."""
    both = {**read_env_file(start), **(os.environ if env is None else env)}
    get = lambda name, default: both.get(f"LOOMGRAPH_{name}", default)
    mode = get("HASH_MODE", "mtime").lower()
    return Config(get("WORKSPACE", "."), get("DATA_DIR", ".loomgraph"), mode if mode in HASH_MODES else "mtime", get("WATCH", "").lower() in ("1", "true", "yes"))
