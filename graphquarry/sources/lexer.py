"""A lexer shared by the parsers of bracketed languages."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

_COMMENT = {
    "hash": r"#[^\n]*",
    "slash": r"//[^\n]*|/\*.*?(?:\*/|\Z)",
}
_STRING = r'"(?:\\.|[^"\\\n])*"?'
_CHAR = r"'(?:\\.|[^'\\\n])*'?"
_TOKEN = re.compile(r"[^\W\d][\w$]*|\$[\w$]*|\d[\w.]*|=>|->|::|==|!=|<=|>=|&&|\|\||:=|\.\.\.|[^\s\w]")


@dataclass
class Tokens:
    """Tokens of a source with lines, and for each bracket the index of its partner."""

    source: str
    text: list[str] = field(default_factory=list)
    start: list[int] = field(default_factory=list)
    end: list[int] = field(default_factory=list)
    line: list[int] = field(default_factory=list)
    partner: list[int] = field(default_factory=list)

    def __len__(self) -> int:
        return len(self.text)

    def at(self, i: int) -> str:
        return self.text[i] if 0 <= i < len(self.text) else ""

    def is_name(self, i: int) -> bool:
        t = self.at(i)
        return bool(t) and (t[0].isalpha() or t[0] in "_$")

    def raw(self, i: int, j: int) -> str:
        """Source from token i to token j, both included."""
        return self.source[self.start[i] : self.end[j]] if i <= j else ""


def lex(source: str, language: str) -> Tokens:
    """Tokens of source; comments are dropped, and a string is one token that starts with its quote."""
    kind = "hash" if language == "python" else "slash"
    strings = [_STRING]
    if language in ("javascript", "typescript", "tsx"):
        strings += [_CHAR, r"`(?:\\.|[^`\\])*`?"]
    elif language == "python":
        strings = [r'"""(?:\\.|[^\\])*?(?:"""|\Z)', r"'''(?:\\.|[^\\])*?(?:'''|\Z)", _STRING, _CHAR]
    elif language == "go":
        strings += [r"`[^`]*`?", _CHAR]
    elif language == "rust":
        strings = [r'r(#*)".*?(?:"\1|\Z)', _STRING, r"'(?:\\.[^']*|[^'\\\n])'"]
    elif language == "csharp":
        strings = [r'\$?@\$?"(?:""|[^"])*"?', r'\$?' + _STRING, _CHAR]
    elif language in ("c", "cpp"):
        strings = [r'R"(?P<d>[^()\s]*)\(.*?\)(?P=d)"', _STRING, _CHAR]
    else:
        strings += [_CHAR]
    skip = re.compile(f"(?P<comment>{_COMMENT[kind]})|(?P<string>{'|'.join(strings)})", re.DOTALL)
    out = Tokens(source)
    line, seen = 1, 0

    def add(text: str, a: int, z: int) -> None:
        nonlocal line, seen
        line += source.count("\n", seen, a)
        seen = a
        out.text.append(text)
        out.start.append(a)
        out.end.append(z)
        out.line.append(line)

    def plain(a: int, z: int) -> None:
        for m in _TOKEN.finditer(source, a, z):
            add(m[0], m.start(), m.end())

    at = 0
    for m in skip.finditer(source):
        plain(at, m.start())
        if m.lastgroup != "comment" and m["comment"] is None:
            q = m[0].lstrip("$@rR#")
            add((q or m[0])[0] + "…", m.start(), m.end())
        at = m.end()
    plain(at, len(source))
    out.partner = [-1] * len(out)
    pairs, stack = {")": "(", "]": "[", "}": "{"}, []
    for i, t in enumerate(out.text):
        if t in "([{" and len(t) == 1:
            stack.append(i)
        elif t in pairs:
            for k in range(len(stack) - 1, -1, -1):  # a stray bracket closes what it can
                if out.text[stack[k]] == pairs[t]:
                    out.partner[i] = stack[k]
                    for o in stack[k:]:
                        out.partner[o] = i
                    del stack[k:]
                    break
    for i in stack:
        out.partner[i] = len(out) - 1
    return out
