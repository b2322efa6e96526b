"""The queries as text, one function a tool; the DataFrames are in ``operators``."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import changes as C
from lodestone.operators import context as X
from lodestone.operators import graph as G
from lodestone.operators import lookup as L
from lodestone.operators import search as S
from lodestone.plans.index import reindex as index_again
from lodestone.project import Project, switched
from lodestone.schema import Index

SHOWN_EXPORTS = 5


def _lines(head: str, rows: DataFrame, show, none: str) -> str:
    """A heading and a line for each row; rows are limited by every caller's query."""
    told = [show(r) for r in rows.collect()]
    return "\n".join([head.format(n=len(told)), *told]) if told else none


def get_status(index: Index) -> str:
    r = L.table_stats(index).first()
    return "\n".join(f"{k}: {r[k]}" for k in r.__fields__)


def set_project(current: Project | None, spark: SparkSession, path: str, now_ms: int, storage: str | None = None) -> tuple[Project | None, str]:
    """The project around ``path``, indexed, in place of the current one, which is closed; and what happened, as text."""
    try:
        project = switched(current, spark, os.path.abspath(path), now_ms, storage)
    except ValueError as error:
        return current, str(error)
    if project is current:
        return current, f"Project is {project.root} already"
    return project, f"Project: {project.root} ({project.counts['indexed']} indexed, {project.counts['skipped']} unchanged, {project.counts['removed']} removed, {project.counts['errors']} failed)"


def reindex(project: Project, path: str | None = None, now_ms: int = 0) -> str:
    """Read one file, or all, again whatever its time."""
    at = None if path is None else project.relative(path)
    r = index_again(project.spark, project.root, project.store, at, now_ms, project.config)
    if at is not None:
        return f"Re-indexed: {at}" if r["indexed"] else f"Failed: {at}" if r["errors"] else f"No changes: {at}"
    return f"Full re-index: {r['indexed']} indexed, {r['skipped']} unchanged, {r['removed']} removed, {r['errors']} failed ({r['time_ms']} ms)"


def find_symbol(index: Index, query: str, kind: str | None = None, scope: str | None = None) -> str:
    rows = L.find_symbol(index.symbols, index.files, query, kind, scope, grams=index.grams)
    return _lines("{n} symbol(s)", rows, lambda r: f"  {r['kind']} {r['name']}{r['signature'] or ''}  {r['path']}:{r['start_line']}-{r['end_line']}{' (exported)' if r['is_exported'] else ''}", f"No symbol matches {query!r}")


def find_references(index: Index, symbol: str, file: str | None = None) -> str:
    rows = L.find_references(index.symbols, index.files, index.imports, index.calls, symbol, file)
    at = lambda r: r["path"] + (f":{r['line']}" if r["line"] is not None else "")
    return _lines(f"{{n}} reference(s) to {symbol}", rows, lambda r: f"  {r['kind']} {at(r)} ({r['context']})", f"No references to {symbol!r}")


def get_dependency_graph(index: Index, path: str, direction: str = "dependents", depth: int = 3) -> str:
    if index.files.where(F.col("path") == path).isEmpty():
        return f"File is not indexed: {path}"
    rows = G.dependency_levels(G.import_edges(index.imports, index.files), path, direction, depth).orderBy("depth", "path")
    told = _lines(f"{direction} of {path}", rows, lambda r: f"  [{r['depth']}] {r['path']} via {r['via']}", f"No {direction} of {path}")
    return told + f"\nTotal: {told.count(chr(10))}" if "\n" in told else told


def get_call_graph(index: Index, function: str, file: str | None = None, depth: int = 2) -> str:
    rows = G.call_tree(index.calls, index.symbols, index.files, function, file, depth)
    if not rows:
        return f"No function matches {function!r}"
    out = []
    for k, r in enumerate(rows):
        later = rows[k + 1 :]
        bars = ""
        for level in range(1, r["depth"] + 1):
            more = next((x["depth"] == level for x in later if x["depth"] <= level), False)
            bars += ("├── " if more else "└── ") if level == r["depth"] else ("│   " if more else "    ")
        place = f" ({r['path']}:{r['line']})" if r["path"] and r["line"] else f" ({r['path']})" if r["path"] else " (unresolved)"
        out.append(bars + r["name"] + place)
    return "\n".join(out)


def get_symbol_source(index: Index, symbol: str, file: str | None = None) -> str:
    r = X.symbol_source(index, symbol, file).first()
    if r is None:
        return f"No symbol matches {symbol!r}"
    head = f"{'export ' if r['is_exported'] else ''}{r['kind']} {r['name']}{' ' + r['signature'] if r['signature'] else ''}"
    return f"{head}\n{r['path']}:{r['start_line']}-{r['to_line']}\n\n{r['source']}"


def get_project_map(index: Index, depth: int = 3) -> str:
    """Directories to ``depth`` with counts, their files, files at the root last with all exports."""
    depth = max(1, min(5, depth))
    counts = {r["dir"]: r for r in G.directory_rollup(index.files, index.exports).collect()}  # of one project
    files = [(r["path"], r["exports"]) for r in G.project_map(index.files, index.exports).collect()]
    out: list[str] = []

    def show(folder: str, level: int) -> None:
        pad, name = "  " * (level - 1), folder.rsplit("/", 1)[-1]
        if level > depth:
            out.append(f"{pad}{name}/ ...")
            return
        out.append(f"{pad}{name}/ ({counts[folder]['files']} files, {counts[folder]['exports']} exports)")
        for sub in sorted(d for d in counts if d.rpartition("/")[0] == folder):
            show(sub, level + 1)
        for path, names in files:
            if path.rpartition("/")[0] == folder:
                told = ", ".join(names[:SHOWN_EXPORTS]) + (", ..." if len(names) > SHOWN_EXPORTS else "")
                out.append(f"{pad}  {path.rsplit('/', 1)[-1]}" + (f": {told}" if names else ""))

    for top in sorted(d for d in counts if "/" not in d):
        show(top, 1)
    out += [p + (f": {', '.join(n)}" if n else "") for p, n in files if "/" not in p]
    return "\n".join(out) or "Nothing is indexed"


def get_changes_since_last_session(index: Index) -> str:
    try:
        rows = C.changes_since_last_session(index)
        if rows is None:
            return "No previous session: this is the first run"
        ended = C.last_snapshot(index.sessions).select(C.iso_time(F.col("ended_at"))).first()[0]
        return _lines(f"{{n}} file(s) changed since the last session ({ended})", rows, lambda r: f"  {r['change']} {r['path']}" + "".join(f" +{x}" for x in r["added"]) + "".join(f" -{x}" for x in r["removed"]), f"No changes since the last session ({ended})")
    except Exception as error:
        if "corrupted snapshot" not in str(error):
            raise
        return "Corrupted session snapshot"


def find_unused_exports(index: Index, scope: str | None = None) -> str:
    rows = L.unused_exports(index.exports, index.files, index.imports, index.symbols, scope)
    return _lines("{n} unused export(s)", rows, lambda r: f"  {r['path']}:{r['start_line'] or '?'} {r['kind']} {r['symbol']}", "No unused exports")


def find_unused_code(index: Index, scope: str | None = None, kind: str | None = None) -> str:
    rows = L.unused_code(index.symbols, index.files, index.refs, index.imports, index.exports, scope, kind)
    return _lines("{n} unused symbol(s)", rows, lambda r: f"  {r['path']}:{r['start_line']}-{r['end_line']} {r['kind']} {r['name']}", "No unused code")


def search_by_pattern(index: Index, pattern: str) -> str:
    if pattern not in L.PATTERNS:
        return f"Unknown pattern {pattern!r}. Patterns: {', '.join(L.PATTERNS)}"
    show = lambda r: "  " + r["path"] + (f":{r['line']}" if r["line"] is not None else "") + (f" {r['name']}" if r["name"] else "") + (f" in {r['caller']}" if r["caller"] else "")
    return _lines(f"{pattern}: {{n}}", L.search_by_pattern(index, pattern), show, f"Nothing found for {pattern}")


def search_code(index: Index, query: str, limit: int = 10) -> str:
    rows = S.search_code(index.files, index.exports, index.tfidf, index.idf, query, limit)
    return _lines("{n} result(s)", rows, lambda r: f"  {r['path']} ({r['score']:.2f})" + (f": {', '.join(r['exports'])}" if r["exports"] else ""), f"Nothing found for {query!r}")


def get_file_summary(index: Index, path: str, now_ms: int) -> str:
    r = X.file_summary(index, path, now_ms).first()
    if r is None:
        return f"File is not indexed: {path}"
    parts = [f"{path}: {r['lines']} lines, indexed {r['indexed']}"]
    for title, field in (("Exports", "exports"), ("Imports", "internal_imports"), ("External", "external_imports"), ("Imported by", "imported_by")):
        if r[field]:
            parts.append(f"{title}: {', '.join(r[field])}")
    return "\n".join(parts)


def get_smart_context(index: Index, path: str) -> str:
    found = X.smart_context(index, path)
    if found["file"].isEmpty():
        return f"File is not indexed: {path}"
    parts = [path, _lines("Symbols ({n})", found["symbols"], lambda r: f"  {r['kind']} {r['name']}{r['signature'] or ''} :{r['start_line']}-{r['end_line']}", "No symbols")]
    parts.append(_lines("Imports ({n})", found["imports"], lambda r: f"  {r['symbol']} from {r['from_path']}" + (f" ({r['kind']}{r['signature'] or ''})" if r["kind"] else ""), "No imports"))
    importers = list(dict.fromkeys(r["path"] for r in found["importers"].collect()))  # 500 rows at most
    parts.append(f"Imported by: {', '.join(importers) or 'none'}")
    test = found["test"].first()
    parts.append(f"Test: {test['path'] if test else 'none'}")
    return "\n".join(parts)
