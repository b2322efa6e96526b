"""Extractors of the brace languages, on the shared scanner.

Each finds the declarations its language has at the top level (methods where
the index names them by their type), imports, calls, and names in use.
"""

from __future__ import annotations

import re

from lodestone.extract.lexing import Source, callee_start, comment_above, find, scan, skip
from lodestone.extract.registry import call, exported, imported, own_exports, register, symbol

_WORDS = {
    "ts": "if for while switch catch function return typeof await new super import async of in do else case throw void delete yield instanceof",
    "go": "if for switch func return go defer select range case map chan struct interface type var const import package make",
    "rust": "if for while match fn return impl loop let mut pub use mod where in as move unsafe else Some Ok Err None",
    "java": "if for while switch catch return new super this synchronized throw else do try assert",
    "csharp": "if for foreach while switch catch return new base this lock using throw else do try nameof typeof sizeof default when",
}
KEYWORDS = {k: set(v.split()) for k, v in _WORDS.items()}


def _calls(s: Source, scopes: list[tuple[int, int, str]], language: str, joins: tuple[str, ...], skip_at: set[int], made: bool = False) -> list[dict]:
    """Calls ``chain(...)`` outside declarations; each with the innermost scope around it."""
    out = []
    for i, t in enumerate(s.tokens):
        if t.text != "(" or t.kind != "sign" or i - 1 in skip_at:
            continue
        k = i - 1
        if language == "rust" and s.is_(k, "!"):
            k -= 1
        if not s.name(k) or s.tokens[k].text in KEYWORDS[language] or s.is_(k - 1, "fn", "func", "function"):
            continue
        first = callee_start(s, k, joins)
        is_new = s.is_(first - 1, "new")
        if is_new and not made:
            continue
        name = re.sub(r"\s+", "", s.text_of(first, i))
        around = [x for x in scopes if x[0] <= i < x[1]]
        out.append(call(name, s.tokens[first].line, min(around, key=lambda x: x[1] - x[0])[2] if around else None))
    return out


def _refs(s: Source, language: str, defined_at: set[int]) -> list[str]:
    return sorted({t.text for i, t in enumerate(s.tokens) if t.kind == "name" and i not in defined_at and t.text not in KEYWORDS[language]})


def _body(s: Source, i: int, end: int) -> int:
    """Index of the block that opens after ``i``, or of the ``;`` that ends without one."""
    return find(s, i, end, "{", ";")


def _quoted(text: str) -> str:
    return text.strip("'\"`")


@register("typescript", "tsx", "javascript")
def extract_typescript(text: str) -> dict:
    s = scan(text, "ts")
    n = len(s.tokens)
    symbols, imports, exports, scopes, defined = [], [], [], [], set()
    line = lambda i: s.tokens[min(i, n - 1)].line

    def statement_end(i: int) -> int:
        """End of an expression statement: a ``;``, or a line that begins anew outside brackets."""
        while i < n and not s.is_(i, ";"):
            j = skip(s, i)
            if j < n and line(j) > line(j - 1) and not s.is_(j, ".", "?.", "=>", "=", "+", "-", "*", "/", "&", "|", "?", ":", ",", ")", "]", "}") and not s.is_(j - 1, "=", "=>", "+", "-", "*", "/", "&", "|", "?", ":", ",", "(", "[", "."):
                return j
            i = j
        return i

    i = 0
    while i < n:
        begin = i
        is_exported = s.is_(i, "export")
        if is_exported:
            i += 1
        default = is_exported and s.is_(i, "default")
        if default:
            i += 1
        while s.is_(i, "declare") or (s.is_(i, "async") and s.is_(i + 1, "function")):
            i += 1
        is_async = s.is_(i - 1, "async")
        doc = comment_above(s, line(begin), ("/**",))
        if s.is_(i, "import") and not s.is_(i + 1, "(", "."):
            end = statement_end(i)
            source_at = next((k for k in range(end - 1, i, -1) if s.tokens[k].kind == "string"), -1)
            if source_at > 0 and s.is_(source_at - 1, "from"):
                path, k = _quoted(s.tokens[source_at].text), i + 1
                type_only = s.is_(k, "type") and not s.is_(k + 1, "from", ",")
                k += type_only
                while k < source_at - 1:
                    if s.is_(k, "{"):
                        inner = k + 1
                        while inner < s.tokens[k].match:
                            if s.is_(inner, "type") and s.name(inner + 1) and not s.is_(inner + 1, "as"):
                                inner += 1
                            if s.name(inner):
                                imports.append(imported(s.tokens[inner].text, path, type_only))
                                defined.add(inner)
                                while inner < s.tokens[k].match and not s.is_(inner, ","):
                                    defined.add(inner)
                                    inner += 1
                            inner += 1
                        k = s.tokens[k].match
                    elif s.is_(k, "*"):
                        imports.append(imported(f"* as {s.tokens[k + 2].text}", path, type_only))
                        defined.add(k + 2)
                        k += 2
                    elif s.name(k):
                        imports.append(imported(s.tokens[k].text, path, type_only))
                        defined.add(k)
                    k += 1
            i = end + s.is_(end, ";")
            continue
        if is_exported and (s.is_(i, "{", "*") or (s.is_(i, "type") and s.is_(i + 1, "{"))):
            end = statement_end(i)
            i += s.is_(i, "type")
            if s.is_(i, "{") and s.is_(s.tokens[i].match + 1, "from") and s.tokens[i].match + 2 < n:
                path, k = _quoted(s.tokens[s.tokens[i].match + 2].text), i + 1
                while k < s.tokens[i].match:
                    if s.name(k):
                        exports.append(exported(s.tokens[k].text, "reexport", True, path))
                        k = find(s, k, s.tokens[i].match, ",")
                    k += 1
                defined.update(range(i, end))
            i = end + s.is_(end, ";")
            continue
        if s.is_(i, "function") and s.name(i + 1) and not s.is_(i + 1, "*"):
            name, open_ = s.tokens[i + 1].text, find(s, i + 2, n, "(")
            body = _body(s, skip(s, open_), n) if open_ < n else n
            while s.is_(body, "{") and s.is_(body - 1, ":", "|", "&", "<", ",", "=>"):  # an object type as the return type
                body = _body(s, skip(s, body), n)
            end = skip(s, body) if s.is_(body, "{") else body
            signature = ("async " if is_async else "") + s.text_of(open_, body)
            symbols.append(symbol(name, "function", line(begin), line(end - 1), is_exported, signature, doc))
            if default:
                exports.append(exported(name, "default"))
            scopes.append((i, end, name))
            defined.add(i + 1)
            i = end
            continue
        if s.is_(i, "class", "interface", "enum") and s.name(i + 1):
            kind, name = s.tokens[i].text, s.tokens[i + 1].text
            body = _body(s, i + 2, n)
            end = skip(s, body) if body < n else n
            symbols.append(symbol(name, kind, line(begin), line(end - 1), is_exported, None, doc))
            if default:
                exports.append(exported(name, "default"))
            defined.add(i + 1)
            if kind == "class":
                k = body + 1
                while k < end - 1:
                    if s.name(k) and s.is_(k + 1, "(") and s.is_(_body(s, skip(s, k + 1), end), "{"):
                        block = _body(s, skip(s, k + 1), end)
                        scopes.append((k, skip(s, block), s.tokens[k].text))
                        defined.add(k)
                        k = skip(s, block)
                    else:
                        k = skip(s, k)
            i = end
            continue
        if s.is_(i, "type") and s.name(i + 1) and s.is_(i + 2, "=", "<"):
            end = statement_end(i)
            symbols.append(symbol(s.tokens[i + 1].text, "type", line(begin), line(end - 1), is_exported, None, doc))
            defined.add(i + 1)
            i = end + s.is_(end, ";")
            continue
        if s.is_(i, "const", "let") and s.name(i + 1):
            end, name = statement_end(i), s.tokens[i + 1].text
            if s.is_(i + 1, "enum") and s.name(i + 2):
                i += 1
                continue
            equals = find(s, i + 2, end, "=")
            value = equals + 1 + s.is_(equals + 1, "async")
            arrow = find(s, value, end, "=>")
            if arrow < end and (s.is_(value, "(", "<") or s.is_(value + 1, "=>")):
                signature = ("async " if s.is_(equals + 1, "async") else "") + s.text_of(value, arrow)
                symbols.append(symbol(name, "function", line(begin), line(end - 1), is_exported, signature, doc))
                scopes.append((i, end, name))
            else:
                symbols.append(symbol(name, "variable", line(begin), line(end - 1), is_exported, None, doc))
            defined.add(i + 1)
            i = end + s.is_(end, ";")
            continue
        if default:
            exports.append(exported(s.tokens[i].text if s.name(i) else "default", "default"))
        i = skip(s, i) if i < n else n
    calls = _calls(s, scopes, "ts", (".", "?."), defined)
    return {"symbols": symbols, "imports": imports, "exports": own_exports(symbols) + exports, "calls": calls, "refs": _refs(s, "ts", defined)}


@register("go")
def extract_go(text: str) -> dict:
    s = scan(text, "go")
    n = len(s.tokens)
    symbols, imports, scopes, defined = [], [], [], set()
    big = lambda x: x[:1].isupper()
    line = lambda i: s.tokens[min(i, n - 1)].line
    i = 0
    while i < n:
        doc = comment_above(s, line(i), ("//", "/*"))
        if s.is_(i, "import"):
            group = s.is_(i + 1, "(")
            end = s.tokens[i + 1].match if group else i + 3
            k = i + 1 + group
            while k < min(end + 1, n):
                if s.tokens[k].kind == "string":
                    path = _quoted(s.tokens[k].text)
                    alias = s.tokens[k - 1].text if (s.name(k - 1) or s.is_(k - 1, ".")) and line(k - 1) == line(k) and not s.is_(k - 1, "import") else path.rsplit("/", 1)[-1]
                    imports.append(imported(alias, path))
                    if not group:
                        break
                k += 1
            i = (end if group else k) + 1
            continue
        if s.is_(i, "func"):
            k, owner = i + 1, ""
            if s.is_(k, "("):
                inside = [t.text for t in s.tokens[k + 1 : s.tokens[k].match] if t.kind == "name"]
                owner = (inside[1] if len(inside) > 1 else inside[0] if inside else "") + "."
                k = s.tokens[k].match + 1
            if s.name(k):
                open_ = find(s, k + 1, n, "(")
                body = open_
                while body < n and not (s.is_(body, "{") and not s.is_(body - 1, "interface", "struct")):
                    if body > open_ and line(body) > line(open_) and not s.is_(open_, "("):
                        break
                    body = skip(s, body)
                end = skip(s, body) if s.is_(body, "{") else body
                name = owner + s.tokens[k].text
                symbols.append(symbol(name, "function", line(i), line(end - 1), big(s.tokens[k].text), s.text_of(open_, body), doc))
                scopes.append((i, end, name))
                defined.add(k)
                i = end
                continue
        if s.is_(i, "type", "var", "const"):
            kind = s.tokens[i].text
            specs = [i + 1]
            if s.is_(i + 1, "("):
                specs, last = [], 0
                for k in range(i + 2, s.tokens[i + 1].match):
                    if line(k) > last and not any(a < k < s.tokens[a].match for a in range(i + 2, k) if s.tokens[a].match > a):
                        specs.append(k)
                    last = line(k)
            for k in specs:
                if not s.name(k):
                    continue
                name, body = s.tokens[k].text, find(s, k + 1, min(n, k + 4), "struct", "interface")
                what = "variable" if kind != "type" else {"struct": "class", "interface": "interface"}.get(s.tokens[body].text if body < min(n, k + 4) else "", "type")
                end = k
                while end + 1 < n and line(skip(s, end)) == line(skip(s, end) - 1) and skip(s, end) < n and s.tokens[skip(s, end)].text != ")":
                    end = skip(s, end)
                stop = skip(s, end) - 1 if end < n else n - 1
                symbols.append(symbol(name, what, line(k if s.is_(i + 1, "(") else i), line(stop), big(name), None, doc))
                defined.add(k)
            i = skip(s, i + 1) if s.is_(i + 1, "(") else i + 2
            continue
        i = skip(s, i)
    return {"symbols": symbols, "imports": imports, "exports": own_exports(symbols), "calls": _calls(s, scopes, "go", (".",), defined), "refs": _refs(s, "go", defined)}


def _use_paths(s: Source, i: int, end: int, prefix: str) -> list[tuple[str, str]]:
    """(last name, path before it) of every leaf of a use tree."""
    out, path = [], prefix
    while i < end:
        if s.is_(i, "{"):
            k, stop = i + 1, s.tokens[i].match
            while k < stop:
                comma = find(s, k, stop, ",")
                out += _use_paths(s, k, comma, path)
                k = comma + 1
            return out
        if s.is_(i, "as"):
            break
        if s.name(i) or s.is_(i, "*"):
            if s.is_(i + 1, "::"):
                path = f"{path}::{s.tokens[i].text}" if path else s.tokens[i].text
            else:
                out.append((s.tokens[i].text, path))
        i += 1
    return out


@register("rust")
def extract_rust(text: str) -> dict:
    s = scan(text, "rust")
    n = len(s.tokens)
    symbols, imports, exports, scopes, defined = [], [], [], [], set()
    line = lambda i: s.tokens[min(i, n - 1)].line
    kinds = {"struct": "class", "enum": "enum", "trait": "interface", "type": "type", "const": "variable", "static": "variable"}

    def items(i: int, stop: int, owner: str) -> None:
        while i < stop:
            begin = i
            while s.is_(i, "#") and s.is_(i + 1, "["):
                i = skip(s, i + 1)
            first, public = i, s.is_(i, "pub")
            if public:
                i += 1
                if s.is_(i, "("):
                    i = skip(s, i)
            while s.is_(i, "async", "unsafe", "extern") or (s.is_(i, "const") and s.is_(i + 1, "fn")) or (i < n and s.tokens[i].kind == "string"):
                i += 1
            doc = "" if owner else comment_above(s, line(begin), ("///", "/**"), run=True)
            if s.is_(i, "fn") and s.name(i + 1):
                open_ = find(s, i + 2, stop, "(")
                body = _body(s, skip(s, open_), stop) if open_ < stop else stop
                end = skip(s, body) if body < stop else stop
                symbols.append(symbol(owner + s.tokens[i + 1].text, "function", line(first), line(end - 1), public, ("async " if s.is_(i - 1, "async") else "") + s.text_of(open_, body), doc))
                scopes.append((i, end, s.tokens[i + 1].text))
                defined.add(i + 1)
                i = end
            elif not owner and s.is_(i, *kinds) and (s.name(i + 1)):
                k = i + 1 + s.is_(i + 1, "mut")
                body = _body(s, k + 1, stop)
                end = skip(s, body) if body < stop else stop
                symbols.append(symbol(s.tokens[k].text, kinds[s.tokens[i].text], line(first), line(end - 1), public, None, doc))
                defined.add(k)
                i = end
            elif not owner and s.is_(i, "impl"):
                body = _body(s, i + 1, stop)
                head = i + 1
                if s.is_(head, "<"):
                    depth = 0
                    while head < body:
                        depth += s.is_(head, "<") - s.is_(head, ">")
                        head += 1
                        if not depth:
                            break
                name = next((s.tokens[k].text for k in range(head, body) if s.name(k)), "")
                if body < stop and s.is_(body, "{"):
                    items(body + 1, s.tokens[body].match, f"{name}.")
                i = skip(s, body) if body < stop else stop
            elif not owner and s.is_(i, "use"):
                end = find(s, i + 1, stop, ";")
                for name, path in _use_paths(s, i + 1, end, ""):
                    imports.append(imported(name, path or name))
                    if public:
                        exports.append(exported(name, "function", True, path or name))
                defined.update(range(i, end))
                i = end + 1
            else:
                i = skip(s, max(i, begin))

    items(0, n, "")
    return {"symbols": symbols, "imports": imports, "exports": own_exports(symbols) + exports, "calls": _calls(s, scopes, "rust", (".", "::"), defined), "refs": _refs(s, "rust", defined)}


_MODIFIERS = set("public private protected internal static final abstract sealed virtual override async readonly partial synchronized native default const extern unsafe new volatile transient required strictfp".split())


def _types(s: Source, language: str, symbols: list, scopes: list, defined: set, doc_starts: tuple[str, ...], run: bool):
    """A walker over type declarations and their members, for Java and C#."""
    n = len(s.tokens)
    line = lambda i: s.tokens[min(i, n - 1)].line
    kinds = {"class": "class", "struct": "class", "interface": "interface", "enum": "enum"}

    def members(i: int, stop: int, owner: str, inherit: bool) -> None:
        while i < stop:
            begin = i
            while s.is_(i, "@") or (language == "csharp" and s.is_(i, "[")):
                i = skip(s, i) if s.is_(i, "[") else skip(s, i + 2) if s.is_(i + 2, "(") else i + 2
            first, marks = i, set()
            while i < stop and s.name(i) and s.tokens[i].text in _MODIFIERS:
                marks.add(s.tokens[i].text)
                i += 1
            doc = comment_above(s, line(begin), doc_starts, run)
            public = inherit or "public" in marks
            if s.is_(i, *kinds, "record"):
                i = skip(s, _body(s, i + 1, stop))  # nested types are left out
                continue
            paren, brace = find(s, i, stop, "("), find(s, i, stop, "{", ";", "=")
            arrow = find(s, i, stop, "=>")
            if paren < min(brace, arrow) and s.name(paren - 1):
                body = find(s, skip(s, paren), stop, "{", ";", "=>")
                end = skip(s, body) if not s.is_(body, "=>") else find(s, body, stop, ";") + 1
                name = f"{owner}.{s.tokens[paren - 1].text}"
                prefix = "async " if "async" in marks else ""
                symbols.append(symbol(name, "function", line(first), line(end - 1), public, prefix + s.text_of(paren, body), doc))
                scopes.append((paren, end, name))
                defined.add(paren - 1)
                i = end
            elif brace < stop or arrow < stop:
                at = min(brace, arrow)
                is_field = s.is_(at, ";", "=")
                name_at = at - 1
                wanted = {"static", "final"} <= marks if language == "java" else True
                end = find(s, at, stop, ";") + 1 if is_field or s.is_(at, "=>") else skip(s, at)
                if not is_field and s.is_(end, "="):
                    end = find(s, end, stop, ";") + 1
                if s.name(name_at) and name_at > i and wanted and (is_field or language == "csharp"):
                    symbols.append(symbol(f"{owner}.{s.tokens[name_at].text}", "variable", line(first), line(end - 1), public, None, doc))
                    defined.add(name_at)
                i = max(end, i + 1)
            else:
                i = skip(s, max(i, begin))

    def types(i: int, stop: int) -> None:
        while i < stop:
            begin = i
            while s.is_(i, "@") or (language == "csharp" and s.is_(i, "[")):
                i = skip(s, i) if s.is_(i, "[") else skip(s, i + 2) if s.is_(i + 2, "(") else i + 2
            first, marks = i, set()
            while i < stop and s.name(i) and s.tokens[i].text in _MODIFIERS:
                marks.add(s.tokens[i].text)
                i += 1
            doc = comment_above(s, line(begin), doc_starts, run)
            if s.is_(i, *kinds) and s.name(i + 1):
                kind, name = kinds[s.tokens[i].text], s.tokens[i + 1].text
                body = _body(s, i + 2, stop)
                end = skip(s, body) if body < stop else stop
                symbols.append(symbol(name, kind, line(first), line(end - 1), "public" in marks, None, doc))
                defined.add(i + 1)
                if s.is_(body, "{") and kind != "enum":
                    members(body + 1, s.tokens[body].match, name, kind == "interface" and ("public" in marks or language == "csharp"))
                i = end
            elif language == "csharp" and s.is_(i, "delegate"):
                paren = find(s, i, stop, "(")
                end = find(s, paren, stop, ";") + 1
                symbols.append(symbol(s.tokens[paren - 1].text, "type", line(first), line(end - 1), "public" in marks, None, doc))
                defined.add(paren - 1)
                i = end
            elif language == "csharp" and s.is_(i, "namespace"):
                body = _body(s, i, stop)
                if s.is_(body, "{"):
                    types(body + 1, s.tokens[body].match)
                i = skip(s, body) if body < stop else stop
            else:
                i = skip(s, max(i, begin))

    types(0, n)


@register("java")
def extract_java(text: str) -> dict:
    s = scan(text, "java")
    symbols, imports, scopes, defined = [], [], [], set()
    for i, t in enumerate(s.tokens):
        if t.text == "import" and t.kind == "name":
            end = find(s, i, len(s.tokens), ";")
            path = re.sub(r"\s+", "", s.text_of(i + 1 + s.is_(i + 1, "static"), end))
            imports.append(imported(path.rsplit(".", 1)[-1], path.removesuffix(".*")))
            defined.update(range(i, end))
    _types(s, "java", symbols, scopes, defined, ("/**",), False)
    return {"symbols": symbols, "imports": imports, "exports": own_exports(symbols), "calls": _calls(s, scopes, "java", (".",), defined, made=True), "refs": _refs(s, "java", defined)}


@register("c_sharp")
def extract_csharp(text: str) -> dict:
    s = scan(text, "csharp")
    symbols, imports, scopes, defined = [], [], [], set()
    for i, t in enumerate(s.tokens):
        if t.text == "using" and t.kind == "name" and s.name(i + 1):
            end = find(s, i, len(s.tokens), ";", "(")
            if s.is_(end, ";") and not s.is_(i + 1, "var"):
                at = find(s, i, end, "=")
                path = re.sub(r"\s+", "", s.text_of(at + 1 if at < end else i + 1 + s.is_(i + 1, "static"), end))
                imports.append(imported(path.rsplit(".", 1)[-1], path))
                defined.update(range(i, end))
    _types(s, "csharp", symbols, scopes, defined, ("///",), True)
    return {"symbols": symbols, "imports": imports, "exports": own_exports(symbols), "calls": _calls(s, scopes, "csharp", (".", "?."), defined, made=True), "refs": _refs(s, "csharp", defined)}
