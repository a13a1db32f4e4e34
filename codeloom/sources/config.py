"""Settings of an index, read from TOML."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass, field, fields


# The names and defaults of the settings.
IGNORED_DIRS = [".git", "node_modules", "target", "dist", "build", "vendor", ".venv", "venv", "__pycache__", ".next", ".nuxt", "coverage", ".codeloom"]
GENERATED_GLOBS = ["**/*.pb.go", "**/*_pb2.py", "**/*.generated.*", "**/*.g.ts"]
LANGUAGES = ["rust", "type_script", "tsx", "java_script", "python", "go"]


@dataclass
class Config:
    """All settings with their defaults; an absent history limit means the whole history."""

    ignored_dirs: list[str] = field(default_factory=lambda: list(IGNORED_DIRS))
    ignored_extensions: list[str] = field(default_factory=list)
    generated_path_globs: list[str] = field(default_factory=lambda: list(GENERATED_GLOBS))
    languages: list[str] = field(default_factory=lambda: list(LANGUAGES))
    max_graph_depth: int = 6
    max_file_size_bytes: int = 2 * 1024 * 1024
    git_history_limit: int | None = None


def load_config(path: str) -> Config:
    """The settings of a TOML file: a missing file gives the defaults, a malformed one, or a value of
    the wrong kind, is an error; names that are no setting are passed over."""
    if not os.path.exists(path):
        return Config()
    with open(path, "rb") as f:
        given = tomllib.load(f)
    config = Config(**{x.name: given[x.name] for x in fields(Config) if x.name in given})
    for name in ("ignored_dirs", "ignored_extensions", "generated_path_globs", "languages"):
        value = getattr(config, name)
        if not isinstance(value, list) or not all(isinstance(v, str) for v in value):
            raise ValueError(f"{name} must be a list of strings")
    if unknown := set(config.languages) - set(LANGUAGES):
        raise ValueError(f"unknown languages: {', '.join(sorted(unknown))}")
    for name in ("max_graph_depth", "max_file_size_bytes", "git_history_limit"):
        value = getattr(config, name)
        if value is not None and (not isinstance(value, int) or isinstance(value, bool) or value < 0):
            raise ValueError(f"{name} must be a whole number")
    return config
