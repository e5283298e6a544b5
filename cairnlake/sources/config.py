"""Configuration files: defaults, then the file, then the environment."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field, replace
from pathlib import Path

import yaml

from cairnlake.functions.params import parse_switch
from cairnlake.operators.rooms import Room


@dataclass(frozen=True)
class Settings:
    """Engine settings of one store."""

    store: str = "store"
    collection: str = "drawers"
    respect_ignore: bool = True
    people: dict[str, str] = field(default_factory=dict)


def load_settings(path: str | Path, environment: dict[str, str] | None = None) -> Settings:
    """Malformed or missing files leave the defaults in place."""
    env = os.environ if environment is None else environment
    settings = Settings()
    try:
        loaded = json.loads(Path(path).read_text(encoding="utf-8-sig"))
        if isinstance(loaded, dict):
            known = {k: v for k, v in loaded.items() if k in Settings.__dataclass_fields__}
            settings = replace(settings, **known)
    except (OSError, ValueError):
        pass
    if env.get("CAIRNLAKE_STORE"):
        settings = replace(settings, store=env["CAIRNLAKE_STORE"])
    switch = parse_switch(env.get("CAIRNLAKE_RESPECT_IGNORE"))
    return settings if switch is None else replace(settings, respect_ignore=switch)


def load_project(path: str | Path) -> tuple[str, list[Room]]:
    """Wing and ordered rooms of a project file; blank keywords are dropped."""
    loaded = yaml.safe_load(Path(path).read_text(encoding="utf-8-sig")) or {}
    rooms = [
        Room(
            str(entry["name"]),
            tuple(str(word) for word in entry.get("keywords") or () if str(word).strip()),
            str(entry.get("description") or ""),
        )
        for entry in loaded.get("rooms") or ()
    ]
    return str(loaded.get("wing") or Path(path).parent.name), rooms


def load_known_names(path: str | Path) -> list[str]:
    """Names of a list file or of its ``names`` entry, lower-cased; empty when unreadable."""
    try:
        loaded = json.loads(Path(path).read_text(encoding="utf-8-sig"))
    except (OSError, ValueError):
        return []
    names = loaded.get("names", []) if isinstance(loaded, dict) else loaded
    return [name.lower() for name in names if isinstance(name, str)]
