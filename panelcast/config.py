"""Settings of the steps, from a TOML file."""

from __future__ import annotations

import tomllib
from pathlib import Path

DEFAULTS = Path(__file__).with_name("settings.toml")


def load(section: str, path: str | Path = DEFAULTS) -> dict:
    """A section's settings: the defaults, and over them what the file at path has."""
    read = lambda p: tomllib.loads(Path(p).read_text(encoding="utf-8")).get(section, {})
    found = read(DEFAULTS) | read(path)
    if not found:
        raise KeyError(section)
    return found
