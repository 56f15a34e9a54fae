"""Layered settings: defaults, then a TOML file, then environment variables."""

from __future__ import annotations

import os
import tomllib
from pathlib import Path
from typing import Any

ENV_PREFIX, ENV_DELIMITER = "TESSEL_", "__"

# The default configuration.
DEFAULTS: dict[str, dict[str, Any]] = {
    "chunking": {"size": 1024, "overlap": 128},
    "embedding": {"provider": "hash", "base_url": "", "model": "", "dimension": 64, "batch": 32, "retries": 3, "normalize": True},
    "lexical": {"tokenizer": "unicode61", "order": "relevance"},
    "retrieval": {"top_k": 10, "fusion": "linear", "norm": "softmax", "semantic_weight": 0.7, "lexical_weight": 0.3, "temperature": 1.0, "rrf_k": 60},
    "discovery": {"ignore_files": []},
}


class ConfigError(ValueError):
    """An unknown key or a value of the wrong kind."""


def coerce(key: str, value: Any) -> Any:
    """The value in the kind of the key's default; text is read as that kind."""
    section, _, name = key.partition(".")
    if section not in DEFAULTS or name not in DEFAULTS[section]:
        raise ConfigError(f"unknown setting {key!r}")
    kind = type(DEFAULTS[section][name])
    try:
        if kind is bool:
            if isinstance(value, str):
                return {"true": True, "1": True, "yes": True, "false": False, "0": False, "no": False}[value.lower()]
            return bool(value)
        if kind is list:
            return [x.strip() for x in value.split(",") if x.strip()] if isinstance(value, str) else list(value)
        return kind(value)
    except (KeyError, TypeError, ValueError):
        raise ConfigError(f"{key} must be {kind.__name__}, not {value!r}") from None


def load(path: str | os.PathLike | None = None, env: dict[str, str] | None = None) -> dict[str, dict[str, Any]]:
    """All settings by section."""
    out = {s: dict(v) for s, v in DEFAULTS.items()}
    if path and Path(path).is_file():
        try:
            data = tomllib.loads(Path(path).read_text("utf-8"))
        except tomllib.TOMLDecodeError as e:
            raise ConfigError(f"{path}: {e}") from None
        for section, values in data.items():
            if not isinstance(values, dict):
                raise ConfigError(f"unknown setting {section!r}")
            for name, value in values.items():
                out.setdefault(section, {})[name] = coerce(f"{section}.{name}", value)
    for key, value in (os.environ if env is None else env).items():
        if key.startswith(ENV_PREFIX) and ENV_DELIMITER in key:
            section, name = key[len(ENV_PREFIX) :].lower().split(ENV_DELIMITER, 1)
            out.setdefault(section, {})[name] = coerce(f"{section}.{name}", value)
    return out


def dump(values: dict[str, dict[str, Any]]) -> str:
    """Settings as TOML, without nulls."""

    def shown(v: Any) -> str:
        if isinstance(v, bool):
            return "true" if v else "false"
        if isinstance(v, list):
            return "[" + ", ".join(map(shown, v)) + "]"
        return str(v) if isinstance(v, (int, float)) else '"' + str(v).replace("\\", "\\\\").replace('"', '\\"') + '"'

    return "\n".join(f"[{s}]\n" + "".join(f"{k} = {shown(v)}\n" for k, v in own.items() if v is not None) for s, own in values.items() if own)


def change(path: str | os.PathLike, key: str, value: Any | None) -> None:
    """Write one setting to the file, or take it out (None)."""
    current = tomllib.loads(Path(path).read_text("utf-8")) if Path(path).is_file() else {}
    section, _, name = key.partition(".")
    if value is None:
        coerce(key, DEFAULTS.get(section, {}).get(name))
        current.get(section, {}).pop(name, None)
    else:
        current.setdefault(section, {})[name] = coerce(key, value)
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(dump(current), "utf-8")
