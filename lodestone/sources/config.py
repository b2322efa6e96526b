"""Project configuration, roots and paths: small files read on the driver."""

from __future__ import annotations

import json
import logging
import os
import re
import sys
from dataclasses import asdict, dataclass, field
from pathlib import Path

log = logging.getLogger(__name__)
CONFIG_NAME = ".lodestone.json"
# What a project is indexed by unless it says otherwise.
DEFAULT_INCLUDE = ["src/", "lib/", "app/", "packages/"]
DEFAULT_EXCLUDE = ["**/*.test.*", "**/*.spec.*", "**/__tests__/**", "**/*_test.go", "**/test_*.py", "**/*_test.py"]
KNOWN_LANGUAGES = ("typescript", "tsx", "javascript", "python", "go", "rust", "java", "c_sharp")
ROOT_MARKERS = ("package.json", "go.mod", "Cargo.toml", "pyproject.toml")
# Folders that are not entered; nor is any whose name begins with a dot.
IGNORED_DIRS = {"node_modules", "dist", "build", "coverage", "out", "__pycache__", "venv", "env", "vendor", "target"}


@dataclass
class Config:
    include: list[str] = field(default_factory=lambda: list(DEFAULT_INCLUDE))
    exclude: list[str] = field(default_factory=lambda: list(DEFAULT_EXCLUDE))
    languages: list[str] = field(default_factory=lambda: list(KNOWN_LANGUAGES))
    max_file_size: int = 1_048_576
    storage: str = "global"


def load_config(root: str) -> Config:
    """The project's file over the defaults; a missing or broken file is the defaults."""
    try:
        given = json.loads(Path(root, CONFIG_NAME).read_text())
        given = given if isinstance(given, dict) else {}
    except (OSError, ValueError):
        given = {}
    known = asdict(Config())
    config = Config(**{k: v for k, v in given.items() if k in known and v is not None})
    for name in config.languages:
        if name not in KNOWN_LANGUAGES:
            log.warning("unknown language %s", name)
    return config


def init_config(root: str) -> Path:
    """Write the defaults; refuses to overwrite."""
    path = Path(root, CONFIG_NAME)
    with path.open("x") as out:
        json.dump(asdict(Config()), out, indent=2)
    return path


def project_root(start: str) -> str:
    """The nearest folder from ``start`` upward that holds a project file, else ``start``."""
    at = Path(start).resolve()
    for folder in [at, *at.parents]:
        if any((folder / m).is_file() for m in ROOT_MARKERS):
            return str(folder)
    return str(at)


def encoded_path(path: str) -> str:
    """A path as one folder name: separators to ``-``, none in front, colons left out."""
    return re.sub(r"[\\/]", "-", path.replace(":", "")).lstrip("-")


def index_path(root: str, storage: str = "global") -> str:
    if storage == "local":
        return os.path.join(root, ".lodestone")
    home = os.environ.get("XDG_CACHE_HOME") or os.path.join(os.path.expanduser("~"), "Library/Caches" if sys.platform == "darwin" else ".cache")
    return os.path.join(home, "lodestone", encoded_path(root))


def _without_comments(text: str) -> str:
    """JSON with comments and trailing commas to JSON; strings are left alone."""
    bare = re.sub(r'("(?:\\.|[^"\\])*")|//[^\n]*|/\*[\s\S]*?\*/', lambda m: m[1] or "", text)
    return re.sub(r'("(?:\\.|[^"\\])*")|,(?=\s*[}\]])', lambda m: m[1] or "", bare)


def ts_aliases(root: str) -> tuple[str | None, list[tuple[str, list[str]]]]:
    """``baseUrl`` and the ``paths`` in their order; nothing if the file is missing or broken."""
    try:
        options = json.loads(_without_comments(Path(root, "tsconfig.json").read_text())).get("compilerOptions", {})
        return options.get("baseUrl"), list(options.get("paths", {}).items())
    except (OSError, ValueError, AttributeError):
        return None, []


def go_module(root: str) -> str | None:
    try:
        found = re.search(r"^module\s+(\S+)", Path(root, "go.mod").read_text(), re.M)
        return found[1] if found else None
    except OSError:
        return None
