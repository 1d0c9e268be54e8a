"""Pipeline settings in YAML, with ${NAME} and ${NAME:default} from the environment."""

from __future__ import annotations

import os
import re
from pathlib import Path

_VARIABLE = re.compile(r"\$\{([A-Za-z_]\w*)(?::([^}]*))?\}")


def resolve(value, environment: dict[str, str] | None = None):
    """Value with its variables filled in, in nested dicts and lists; unset ones without default raise ValueError."""
    env = os.environ if environment is None else environment
    if isinstance(value, dict):
        return {k: resolve(v, env) for k, v in value.items()}
    if isinstance(value, list):
        return [resolve(v, env) for v in value]
    if not isinstance(value, str):
        return value

    def put(m: re.Match) -> str:
        if m.group(1) in env:
            return env[m.group(1)]
        if m.group(2) is None:
            raise ValueError(f"environment variable {m.group(1)} is not set and has no default")
        return m.group(2)

    return _VARIABLE.sub(put, value)


def load(path: str) -> dict:
    import yaml

    return resolve(yaml.safe_load(Path(path).read_text()) or {})


def severities(config: dict | None, dialect: str = "sqlite") -> dict[str, list[str]] | None:
    """The severity lists of a dialect: config by dialect, or one for all; sqlite's if there is none for it; None if empty."""
    if not config:
        return None
    name = {"postgres": "postgresql", "pg": "postgresql"}.get(dialect.lower(), dialect.lower())
    if any(isinstance(v, dict) for v in config.values()):
        return config.get(name) or config.get("sqlite")
    return config
