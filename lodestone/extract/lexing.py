"""A small scanner for brace languages: tokens with lines, brackets matched, comments apart.

It is no parser. It knows strings, comments, numbers, names and single signs,
which is enough to find top-level declarations, imports, calls with their
enclosing declaration, and names in use.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

OPEN, CLOSE = "([{", ")]}"


@dataclass
class Token:
    kind: str  # name, string, number, sign
    text: str
    line: int
    at: int
    match: int = -1  # index of the matching bracket


@dataclass
class Source:
    text: str
    tokens: list[Token] = field(default_factory=list)
    comments: list[tuple[int, int, str]] = field(default_factory=list)  # first line, last line, text

    def text_of(self, i: int, j: int) -> str:
        """Source text from token ``i`` up to token ``j``, which is left out."""
        if i >= len(self.tokens):  # an unfinished file
            return ""
        end = self.tokens[j].at if j < len(self.tokens) else len(self.text)
        return self.text[self.tokens[i].at : end].strip()

    def is_(self, i: int, *texts: str) -> bool:
        return 0 <= i < len(self.tokens) and self.tokens[i].text in texts and self.tokens[i].kind != "string"

    def name(self, i: int) -> bool:
        return 0 <= i < len(self.tokens) and self.tokens[i].kind == "name"


_BASE = r"(?P<space>[ \t\r\f]+)|(?P<newline>\n)|(?P<comment>{comments})|(?P<string>{strings})|(?P<number>\d[\w.]*)|(?P<name>[^\W\d][\w]*{more})|(?P<sign>::|\?\.|=>|->|\.\.\.|:=|.)"
_BLOCK = r"/\*[\s\S]*?(?:\*/|\Z)|//[^\n]*"
_DOUBLE = r'"(?:\\[\s\S]|[^"\\\n])*"?'
_SINGLE = r"'(?:\\[\s\S]|[^'\\\n])*'?"
_TICK = r"`(?:\\[\s\S]|[^`\\])*`?"
RULES = {
    "ts": re.compile(_BASE.format(comments=_BLOCK, strings=f"{_DOUBLE}|{_SINGLE}|{_TICK}", more=r"[\w$]*").replace(r"[^\W\d]", r"(?:[^\W\d]|\$)")),
    "go": re.compile(_BASE.format(comments=_BLOCK, strings=f"{_DOUBLE}|`[^`]*`?|'(?:\\\\.|[^'\\\\\\n])+'", more="")),
    "rust": re.compile(_BASE.format(comments=_BLOCK, strings=r'b?r#+"[\s\S]*?"#+|b?r?' + r'"(?:\\[\s\S]|[^"\\])*"?' + r"|b?'(?:\\[^\n]|[^'\\\n])'", more="")),
    "java": re.compile(_BASE.format(comments=_BLOCK, strings=f'"""[\\s\\S]*?"""|{_DOUBLE}|{_SINGLE}', more=r"\$?")),
    "csharp": re.compile(_BASE.format(comments=_BLOCK, strings=r'[$@]*@[$@]*"(?:""|[^"])*"|\$?' + _DOUBLE + "|" + _SINGLE, more="")),
}


def scan(text: str, rules: str) -> Source:
    out, line, stack = Source(text), 1, []
    for m in RULES[rules].finditer(text):
        kind, part = m.lastgroup, m.group()
        if kind == "comment":
            out.comments.append((line, line + part.count("\n"), part))
        elif kind not in ("space", "newline"):
            token = Token(kind, part, line, m.start())
            if kind == "sign" and part in OPEN:
                stack.append(len(out.tokens))
            elif kind == "sign" and part in CLOSE and stack:
                token.match = stack.pop()
                out.tokens[token.match].match = len(out.tokens)
            out.tokens.append(token)
        line += part.count("\n")
    for i in stack:  # never closed: reaches the end
        out.tokens[i].match = len(out.tokens) - 1
    return out


def skip(source: Source, i: int) -> int:
    """Index after the token at ``i``, or after its whole bracket."""
    if i >= len(source.tokens):
        return i + 1
    t = source.tokens[i]
    return max(t.match, i) + 1 if t.text in OPEN and t.kind == "sign" else i + 1


def find(source: Source, i: int, end: int, *texts: str) -> int:
    """First of ``texts`` from ``i`` on, outside brackets opened on the way; ``end`` if none."""
    while i < end:
        if source.is_(i, *texts):
            return i
        i = skip(source, i)
    return end


def comment_above(source: Source, line: int, starts: tuple[str, ...], run: bool = False) -> str:
    """The comment that ends on the line before ``line``; with ``run`` all such lines in a row."""
    found: list[str] = []
    for _first, last, text in reversed(source.comments):
        if last == line - 1 and text.startswith(starts):
            found.insert(0, text)
            line = _first
            if not run or text.startswith("/*"):
                break
        elif last < line - 1:
            break
    return "\n".join(found)


def callee_start(source: Source, i: int, joins: tuple[str, ...]) -> int:
    """First token of the member chain that ends at name ``i``."""
    while source.is_(i - 1, *joins):
        before = i - 2
        if source.is_(before, ")", "]", ">") and source.tokens[before].match >= 0:
            i = source.tokens[before].match
            if source.name(i - 1):
                i -= 1
            elif not source.is_(i, "("):
                return i
        elif source.name(before) or (before >= 0 and source.tokens[before].kind == "string"):
            i = before
        else:
            break
    return i
