"""Settings of a run from JSON, TOML or YAML files, project files or the environment, read on the driver."""

from __future__ import annotations

import hashlib
import json
import os
import tomllib
from dataclasses import asdict, dataclass, field, replace
from pathlib import Path


@dataclass(frozen=True)
class Config:
    """What a run may be told; unknown keys are an error."""

    enabled_rules: tuple[str, ...] = ()
    disabled_rules: tuple[str, ...] = ()
    enabled_dimensions: tuple[str, ...] = ("security", "performance", "reliability", "compliance", "quality", "cost")
    dialect: str | None = None
    #: Characters from which Analysis.overlong lists a statement; it is analysed all the same.
    max_query_length: int = 100_000
    severity_overrides: dict[str, str] = field(default_factory=dict)
    #: Contexts by patterns of paths, before all others.
    context_overrides: dict[str, str] = field(default_factory=dict)
    directive_prefix: str = "sqllint"
    fail_on: str = "high"

    def with_overrides(self, **values) -> Config:
        return replace(self, **_checked(values))

    @property
    def digest(self) -> str:
        """Changes with any setting: part of a result cache's key."""
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True, default=list).encode()).hexdigest()[:16]


def _checked(values: dict) -> dict:
    unknown = set(values) - set(Config.__dataclass_fields__)
    if unknown:
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    return {k: tuple(v) if isinstance(v, list) else v for k, v in values.items()}


def parse(text: str, suffix: str, section: str | None = None) -> Config:
    """Settings from a text in the format of the suffix; `section` names a part of it, dotted."""
    if suffix == ".toml":
        loaded = tomllib.loads(text)
    elif suffix == ".json":
        loaded = json.loads(text or "{}")
    else:
        import yaml  # optional: the other formats need nothing beyond the standard library

        loaded = yaml.safe_load(text)
    for part in section.split(".") if section else ():
        loaded = (loaded or {}).get(part, {})
    return Config().with_overrides(**(loaded or {}))


def find(start: Path, names: tuple[str, ...] = ("strataql.toml", "strataql.yaml", "strataql.yml", "strataql.json"), env_prefix: str = "STRATAQL_") -> Config:
    """The nearest settings file in a folder or above it, else pyproject.toml's tool section, else the environment."""
    for folder in (start, *start.parents):
        for name in names:
            if (folder / name).is_file():
                return parse((folder / name).read_text(), (folder / name).suffix)
        project = folder / "pyproject.toml"
        if project.is_file() and "strataql" in tomllib.loads(project.read_text()).get("tool", {}):
            return parse(project.read_text(), ".toml", "tool.strataql")
    return from_env(env_prefix)


def from_env(prefix: str = "STRATAQL_") -> Config:
    """Settings from environment variables: lists by commas, whole numbers as such."""
    found = {}
    for key, value in os.environ.items():
        name = key.removeprefix(prefix).lower()
        if not key.startswith(prefix) or name not in Config.__dataclass_fields__:
            continue
        default = getattr(Config(), name)
        found[name] = tuple(x.strip() for x in value.split(",") if x.strip()) if isinstance(default, tuple) else int(value) if isinstance(default, int) else value
    return Config().with_overrides(**found)
