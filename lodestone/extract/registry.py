"""Which extractor reads which language."""

from __future__ import annotations

from collections.abc import Callable

Extractor = Callable[[str], dict]
EXTRACTORS: dict[str, Extractor] = {}


def register(*languages: str) -> Callable[[Extractor], Extractor]:
    """Make a function the extractor of these grammars."""

    def add(f: Extractor) -> Extractor:
        EXTRACTORS.update(dict.fromkeys(languages, f))
        return f

    return add


def extract(language: str, text: str) -> dict:
    """Everything found in one file; an unknown language has nothing."""
    from lodestone.extract import languages, python_source  # noqa: F401  registers

    empty = {"symbols": [], "imports": [], "exports": [], "calls": [], "refs": []}
    found = EXTRACTORS.get(language, lambda _: {})(text)
    return {**empty, **found}


def symbol(name: str, kind: str, start: int, end: int, exported: bool, signature: str | None = None, doc: str = "") -> dict:
    return {"name": name, "kind": kind, "start_line": start, "end_line": end, "is_exported": exported, "signature": signature, "doc": doc or None}


def imported(name: str, path: str, type_only: bool = False) -> dict:
    return {"symbol": name, "from_path": path, "is_type_only": type_only}


def exported(name: str, kind: str, reexport: bool = False, path: str | None = None) -> dict:
    return {"symbol": name, "kind": kind, "is_reexport": reexport, "from_path": path}


def call(name: str, line: int, parent: str | None) -> dict:
    return {"callee_name": name, "line": line, "parent_symbol": parent}


def own_exports(symbols: list[dict]) -> list[dict]:
    return [exported(s["name"], s["kind"]) for s in symbols if s["is_exported"]]
