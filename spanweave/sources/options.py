"""Settings from the environment or a file of KEY=VALUE lines; what the environment has stands."""

from __future__ import annotations

import os
from collections.abc import Mapping, MutableMapping


def flag(name: str, default: bool = False, env: Mapping[str, str] | None = None) -> bool:
    """True for 1, true and yes in any case."""
    value = (os.environ if env is None else env).get(name)
    return default if value is None else value.strip().lower() in {"1", "true", "yes"}


def load(path: str, env: MutableMapping[str, str]) -> MutableMapping[str, str]:
    """Add the file's settings that ``env`` lacks; blank lines, comments and a missing file count for nothing."""
    if os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            for line in f:
                key, found, value = line.strip().partition("=")
                if found and key.strip() and not key.startswith("#"):
                    env.setdefault(key.strip(), value.strip().strip("\"'"))
    return env


def endpoint(candidates: list[str | None], answers) -> str | None:
    """The first address that ``answers`` (address to whether it is up) accepts; unset ones are passed over."""
    return next((c for c in candidates if c and answers(c)), None)
