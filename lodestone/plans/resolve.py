"""Import resolution as a join: candidate paths of an import against the listing.

Every import is expanded to the paths it may mean, best first; the first that
is in the listing of the whole tree (not only of the indexed files) wins.
"""

from __future__ import annotations

import posixpath

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_JS = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs")


def _js_files(base: str) -> list[str]:
    """What a script path without a certain extension may name."""
    stem = base
    for ext in (".js", ".mjs", ".cjs", ".jsx"):
        if base.endswith(ext):
            stem = base[: -len(ext)]
    return [base, *(stem + e for e in _JS), *(f"{stem}/index{e}" for e in _JS)]


def candidates(from_path: str, importer: str, lang: str, aliases: tuple = (None, []), module: str | None = None) -> tuple[list[str], str | None]:
    """Paths to look for, in order, and the path of an internal import that none of them meets.

    ``folder/*.ext`` stands for the first file of that kind in a folder.
    """
    folder = posixpath.dirname(importer)
    here = lambda p: posixpath.normpath(posixpath.join(folder, p))
    if lang in ("typescript", "tsx", "javascript"):
        if from_path.startswith("."):
            return _js_files(here(from_path)), here(from_path)
        base, out = aliases[0], []
        for pattern, targets in aliases[1]:
            head = pattern.removesuffix("*")
            if (pattern.endswith("*") and from_path.startswith(head)) or pattern == from_path:
                for t in targets:
                    out += _js_files(posixpath.normpath(posixpath.join(base or ".", t.removesuffix("*") + (from_path[len(head) :] if pattern.endswith("*") else ""))))
        return out + (_js_files(posixpath.normpath(posixpath.join(base, from_path))) if base else []), None
    if lang == "python":
        dots = len(from_path) - len(from_path.lstrip("."))
        rest = from_path[dots:].replace(".", "/")
        if dots:
            at = posixpath.normpath(posixpath.join(folder, *[".."] * (dots - 1), rest))
            return [f"{at}.py", f"{at}/__init__.py"], at
        return [f"{rest}.py", f"{rest}/__init__.py"], None
    if lang == "go" and module and (from_path == module or from_path.startswith(module + "/")):
        inner = from_path[len(module) :].strip("/")
        return [f"{inner}/*.go" if inner else "*.go"], None
    if lang == "rust":
        head, *tail = from_path.split("::")
        at = {"crate": "src", "self": folder, "super": posixpath.dirname(folder) if posixpath.basename(importer) in ("mod.rs", "lib.rs") else folder}.get(head)
        if at is None or not tail:
            return [], None
        return [p for k in range(len(tail), 0, -1) for p in (posixpath.join(at, *tail[:k]) + ".rs", posixpath.join(at, *tail[:k], "mod.rs"))], None
    if lang == "java":
        path = from_path.replace(".", "/")
        roots = ("src/main/java/", "src/", "")
        return [f"{r}{path}.java" for r in roots] + [f"{r}{path}/*.java" for r in roots], None
    return [], None


def resolved(imports: DataFrame, listing: DataFrame, aliases: tuple = (None, []), module: str | None = None) -> DataFrame:
    """``imports(path, lang, from_path, ...)`` with ``from_path`` resolved and ``is_external``.

    Candidates come from an Arrow function over the distinct (file, import)
    pairs; finding them is a join on the path.
    """
    @F.pandas_udf("struct<tried: array<string>, otherwise: string>")
    def expand(from_path: pd.Series, importer: pd.Series, lang: pd.Series) -> pd.DataFrame:
        found = [candidates(f, i, k, aliases, module) for f, i, k in zip(from_path, importer, lang)]
        return pd.DataFrame({"tried": [t for t, _ in found], "otherwise": [o for _, o in found]})

    pairs = imports.select("path", "lang", "from_path").distinct().withColumn("c", expand("from_path", "path", "lang"))
    tried = pairs.select("path", "from_path", F.posexplode("c.tried").alias("pos", "target"))
    folder = F.when(F.col("path").contains("/"), F.concat(F.regexp_replace("path", "/[^/]*$", ""), F.lit("/"))).otherwise(F.lit(""))
    kind = F.regexp_extract("path", r"(\.[^./]+)$", 1)
    first = listing.where(kind.isin(".go", ".java") & ~F.col("path").endswith("_test.go")).groupBy(F.concat(folder, F.lit("*"), kind).alias("target")).agg(F.min("path").alias("found"))
    there = listing.select(F.col("path").alias("target"), F.col("path").alias("found")).unionByName(first)
    best = tried.join(there, "target").groupBy("path", "from_path").agg(F.min_by("found", "pos").alias("found"))
    named = pairs.select("path", "from_path", F.col("c.otherwise").alias("otherwise")).join(best, ["path", "from_path"], "left")
    out = imports.join(named, ["path", "from_path"], "left")
    to = F.coalesce("found", "otherwise")
    return out.withColumn("is_external", to.isNull()).withColumn("from_path", F.coalesce(to, "from_path")).drop("found", "otherwise")
