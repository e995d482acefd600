"""Configuration files: YAML with ${env:NAME} and ${env:NAME:default}; secrets are hidden when shown."""

from __future__ import annotations

import os
import re

import yaml

from strataweave.errors import EngineError

_ENV = re.compile(r"\$\{env:([A-Za-z_][A-Za-z0-9_]*)(?::([^}]*))?\}")
_HIDDEN = re.compile(r"key|token|secret|password", re.IGNORECASE)
KNOWN = {"store", "registry", "adapters", "policy", "codec", "spark", "shadow"}


def expand(value, env: dict | None = None):
    """value with references to the environment filled in; one without default that isn't set is an error."""
    env = os.environ if env is None else env
    if isinstance(value, dict):
        return {k: expand(v, env) for k, v in value.items()}
    if isinstance(value, list):
        return [expand(v, env) for v in value]
    if not isinstance(value, str):
        return value

    def one(m: re.Match) -> str:
        if m[1] in env:
            return env[m[1]]
        if m[2] is None:
            raise EngineError("config_invalid", f"environment variable {m[1]} is not set")
        return m[2]

    return _ENV.sub(one, value)


def load(text: str, env: dict | None = None) -> dict:
    found = yaml.safe_load(text) or {}
    if not isinstance(found, dict):
        raise EngineError("config_invalid", "a configuration is a mapping")
    if unknown := set(found) - KNOWN:
        raise EngineError("config_invalid", f"unknown settings {sorted(unknown)}")
    return expand(found, env)


def redacted(value, name: str = ""):
    """The same with values of secret-looking names hidden."""
    if isinstance(value, dict):
        return {k: redacted(v, str(k)) for k, v in value.items()}
    if isinstance(value, list):
        return [redacted(v, name) for v in value]
    return "***" if _HIDDEN.search(name) and value not in (None, "") else value
