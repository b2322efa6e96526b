"""Text functions as column expressions; the Python forms are for query strings."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Both edges stand before a capital, which is looked for first: it fails fast at most places.
_CASE_EDGE = r"(?=[A-Z])(?:(?<=[a-z])|(?<=[A-Z0-9])(?=[A-Z][a-z]))"
_NOT_ALNUM = r"[^A-Za-z0-9]+"
#: Extensions and the grammar each one selects.
LANGUAGES = {
    ".ts": "typescript", ".mts": "typescript", ".cts": "typescript", ".tsx": "tsx",
    ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript",
    ".py": "python", ".go": "go", ".rs": "rust", ".java": "java", ".cs": "c_sharp",
}
DECLARATION_SUFFIXES = (".d.ts", ".d.mts", ".d.cts")


def tokenize(text: Column) -> Column:
    """ASCII words of two letters or more, camel case split, in lower case.

    Lower-casing comes last: letters outside ASCII that fold into it must not
    join a word.
    """
    parts = F.split(F.regexp_replace(text, _CASE_EDGE, " "), _NOT_ALNUM)
    return F.transform(F.filter(parts, lambda x: F.length(x) > 1), lambda x: F.lower(x))


def tokens_of(text: str) -> list[str]:
    """``tokenize`` for one Python string."""
    return [x.lower() for x in re.split(_NOT_ALNUM, re.sub(_CASE_EDGE, " ", text)) if len(x) > 1]


def escaped(text: str) -> str:
    """``text`` for use inside a LIKE pattern whose escape sign is ``!``."""
    return re.sub(r"([!%_])", r"!\1", text)


def ilike(column: Column, pattern: str) -> Column:
    return F.ilike(column, F.lit(pattern), F.lit("!"))


def ilike_any(column: Column, patterns: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [ilike(column, p) for p in patterns])


def name_pattern(query: str) -> str:
    """The LIKE pattern of a name in which ``*`` stands for any run of signs."""
    return escaped(query).replace("*", "%")


def name_matches(column: Column, query: str) -> Column:
    """Case-insensitive equality in which ``*`` stands for any run of signs."""
    return ilike(column, name_pattern(query))


def path_under(column: Column, scope: str | None) -> Column:
    """Case-insensitive literal prefix; no scope is no condition."""
    return F.lit(True) if not scope else ilike(column, escaped(scope) + "%")


def glob_regex(pattern: str) -> str:
    """Anchored regex of a glob: ``**`` any signs, ``*`` and ``?`` none across ``/``."""
    out, i = "", 0
    while i < len(pattern):
        if pattern.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        out += {"*": "[^/]*", "?": "[^/]"}.get(pattern[i], re.escape(pattern[i]))
        i += 1
    return f"^{out}$"


def matches_any_glob(column: Column, patterns: list[str]) -> Column:
    if not patterns:
        return F.lit(False)
    return column.rlike("|".join(f"(?:{glob_regex(p)})" for p in patterns))


def extension(path: Column) -> Column:
    return F.regexp_extract(path, r"(\.[^./]+)$", 1)


def language(path: Column) -> Column:
    """Grammar of a path, or null."""
    table = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.try_element_at(table, extension(path))


def is_source(path: Column) -> Column:
    declared = reduce(lambda a, b: a | b, [path.endswith(s) for s in DECLARATION_SUFFIXES])
    return language(path).isNotNull() & ~declared


def line_count(content: Column) -> Column:
    return F.size(F.split(content, "\n", -1))


def content_hash(content: Column) -> Column:
    return F.substring(F.sha2(content, 256), 1, 16)


def normalized_path(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def directory(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def ancestors(path: Column) -> Column:
    """Directories above a path, outermost first; none for a file at the root."""
    parts = F.split(path, "/")
    some = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    return F.when(F.size(parts) > 1, some).otherwise(F.array().cast("array<string>"))


def age_text(then_ms: Column, now_ms: Column) -> Column:
    """``just now`` under a minute, else rounded minutes, hours or days."""
    s = (now_ms - then_ms) / 1000
    told = lambda unit, sign: F.concat(F.floor(s / unit + 0.5).cast("string"), F.lit(sign))
    return F.when(s < 60, F.lit("just now")).when(s < 3600, told(60, "m ago")).when(s < 86400, told(3600, "h ago")).otherwise(told(86400, "d ago"))
