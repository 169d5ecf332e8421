"""Symbols, imports and calls of source files in ten languages.

Python is read by the standard library's parser; other languages, and Python that it rejects, by
recognisers of declarations and calls over tokens.  A file that defies them gives what was found.
"""

from __future__ import annotations

import ast
import re
from dataclasses import dataclass, field

from .lexer import Tokens, lex


@dataclass
class Found:
    """Symbols in order of appearance; parents and callers are positions in that order."""

    symbols: list[dict] = field(default_factory=list)
    imports: list[dict] = field(default_factory=list)
    calls: list[dict] = field(default_factory=list)

    def symbol(self, name: str, kind: str, line_start: int, line_end: int, parent: int | None = None, signature: str | None = None) -> int:
        self.symbols.append({"name": name, "kind": kind, "line_start": line_start, "line_end": line_end, "parent": parent, "signature": signature})
        return len(self.symbols) - 1

    def use(self, module: str, names: list[str] | None = None) -> None:
        self.imports.append({"module": module, "names": ", ".join(names) if names else None})

    def call(self, caller: int, callee: str, line: int) -> None:
        self.calls.append({"caller": caller, "callee": callee, "line": line})

    def first(self, name: str, *kinds: str) -> int | None:
        return next((i for i, s in enumerate(self.symbols) if s["name"] == name and s["kind"] in kinds), None)


def parse(language: str | None, source: str) -> Found:
    """What a file of a language declares, imports and calls; unknown languages and bad files give what they can."""
    out = Found()
    if language == "python":
        try:
            tree = ast.parse(source)
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            _python_tokens(lex(source, "python"), source, out)
            return out
        _python(tree, source, out, None)
        return out
    reader = {"javascript": _script, "typescript": _script, "tsx": _script, "rust": _rust, "go": _go, "java": _java, "c": _c, "cpp": _cpp, "csharp": _csharp}.get(language or "")
    if reader:
        try:
            reader(lex(source, language), out, language)
        except (IndexError, RecursionError):
            pass  # the text breaks off inside a declaration; what came before it stands
    return out


# --- Python


def _head(source: str, lines: list[str], node) -> str:
    offset = sum(len(x) for x in lines[: node.lineno - 1])
    m = re.compile(r"def\s+\w+\s*(?:\[[^\]]*\])?\s*(\()").search(source, offset)
    if not m:
        return "()"
    t = lex(source[m.start(1) :][:20_000], "python")
    return t.raw(0, t.partner[0])


def _python(node: ast.AST, source: str, out: Found, parent: int | None) -> None:
    lines = source.splitlines(keepends=True)

    def calls(n: ast.AST, caller: int, own: bool = False) -> None:
        children = ast.iter_child_nodes(n)
        if own:
            decorators = set(map(id, n.decorator_list))
            children = (c for c in children if id(c) not in decorators)
        for c in children:
            if isinstance(c, ast.Call):
                f = c.func
                name = f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else None
                if name:
                    out.call(caller, name, c.lineno)
            calls(c, caller)

    def visit(n: ast.AST, parent: int | None) -> None:
        for c in ast.iter_child_nodes(n):
            if isinstance(c, ast.FunctionDef | ast.AsyncFunctionDef):
                i = out.symbol(c.name, "function" if parent is None else "method", c.lineno, c.end_lineno, parent, f"def {c.name}{_head(source, lines, c)}")
                calls(c, i, own=True)
                visit(c, i)
            elif isinstance(c, ast.ClassDef):
                visit(c, out.symbol(c.name, "class", c.lineno, c.end_lineno, parent))
            elif isinstance(c, ast.Import):
                out.use((ast.get_source_segment(source, c) or "").removeprefix("import ").strip())
            elif isinstance(c, ast.ImportFrom):
                if c.module != "__future__":
                    out.use("." * c.level + (c.module or ""), [a.name for a in c.names if a.name != "*"])
            else:
                visit(c, parent)

    visit(node, parent)


def _python_tokens(t: Tokens, source: str, out: Found) -> None:
    """Python that doesn't parse: declarations by indentation."""
    lines = source.split("\n")
    indent = lambda n: len(lines[n - 1]) - len(lines[n - 1].lstrip())
    open_: list[tuple[int, int]] = []  # indentation and symbol
    first = None
    for i in range(len(t)):
        starts = t.line[i] != t.line[i - 1] if i else True
        if starts:
            first = i
            while open_ and indent(t.line[i]) <= open_[-1][0] and t.at(i) not in (")", "]", "}"):
                open_.pop()
        w = t.at(i)
        if w in ("def", "class") and t.is_name(i + 1) and (i == first or t.at(i - 1) == "async"):
            col = indent(t.line[i])
            end = t.line[i]
            for n in range(t.line[i] + 1, len(lines) + 1):
                if lines[n - 1].strip():
                    if indent(n) <= col:
                        break
                    end = n
            parent = open_[-1][1] if open_ else None
            sig = f"def {t.at(i + 1)}{t.raw(i + 2, t.partner[i + 2])}" if w == "def" and t.at(i + 2) == "(" else None
            kind = "class" if w == "class" else "function" if parent is None else "method"
            open_.append((col, out.symbol(t.at(i + 1), kind, t.line[i], end, parent, sig)))
        elif w == "import" and i == first:
            out.use(source.split("\n")[t.line[i] - 1].strip().removeprefix("import ").strip())
        elif t.is_name(i) and t.at(i + 1) == "(" and t.at(i - 1) not in ("def", "class"):
            for _, s in open_:
                if out.symbols[s]["kind"] != "class":
                    out.call(s, w, t.line[i])


# --- what the bracketed languages share

_C_WORDS = "if for while do switch case return else sizeof alignof defined "
_SCRIPT_WORDS = "if for while do switch case catch return else function new typeof instanceof void await yield throw delete super of in let const var import "
#: Words that stand before a bracket without calling anything.
_NOT_CALLS = {
    k: set(v.split())
    for k, v in {
        "python": "if for while return else elif in not and or lambda yield await assert del with except is import from as raise",
        "javascript": _SCRIPT_WORDS,
        "typescript": _SCRIPT_WORDS,
        "tsx": _SCRIPT_WORDS,
        "rust": "if for while match loop return else fn impl as where move in let use pub",
        "go": "if for switch select go defer return else func range struct interface map chan case var const type import",
        "java": "if for while do switch case catch return else synchronized super this assert throw try new instanceof",
        "c": _C_WORDS,
        "cpp": _C_WORDS + "catch noexcept decltype static_cast dynamic_cast reinterpret_cast const_cast new delete throw alignas static_assert typeid",
        "csharp": "if for foreach while do switch case catch return else using lock fixed typeof default checked unchecked when sizeof new base this await",
    }.items()
}
_DECLARES = set("return else throw new await yield in case co_return co_await not and or goto delete".split())


def _calls(t: Tokens, lo: int, hi: int, caller: int, out: Found, language: str) -> None:
    """Calls among the tokens [lo, hi), in order."""
    for i in range(lo, hi):
        w = t.at(i)
        if not t.is_name(i):
            continue
        n, before = t.at(i + 1), t.at(i - 1)
        if language in ("java", "csharp") and before == "new":
            j = i
            while t.at(j + 1) == "." and t.is_name(j + 2):
                j += 2
            k = _past_angles(t, j + 1)
            if t.at(k) == "(" or language == "csharp" and t.at(k) == "{":
                out.call(caller, t.at(j), t.line[i - 1])
            continue
        if language == "rust" and n == "!" and t.at(i + 2) in ("(", "[", "{"):
            out.call(caller, w, t.line[i])
            continue
        if language in ("javascript", "tsx", "typescript"):
            if w == "import" and n == "(" and t.at(i + 2).endswith("…"):
                out.use(t.raw(i + 2, i + 2).strip("'\"`"))
                continue
            if before == "<" and language != "typescript" and not (t.is_name(i - 2) and t.line[i - 2] == t.line[i] and t.at(i - 2) != "return"):
                j = i
                while t.at(j + 1) == "." and t.is_name(j + 2):
                    j += 2
                if j > i or w[0].isupper():
                    out.call(caller, t.at(j), t.line[i])
                continue
        generic = language == "csharp" and n == "<" and t.at(_past_angles(t, i + 1)) == "("
        if (n == "(" or generic) and w not in _NOT_CALLS[language]:
            if before in ("function", "fn", "def", "func"):
                continue
            if language in ("javascript", "typescript", "tsx", "c", "cpp") and _after_new(t, i):
                continue
            if language == "java" and _qualified_new(t, i):
                continue
            if language in ("c", "cpp", "csharp", "java") and t.is_name(i - 1) and before not in _DECLARES:
                continue  # a local declaration
            if language in ("javascript", "typescript", "tsx") and t.at(t.partner[i + 1] + 1) == "{" and before in ("{", "}", ";", "async", "get", "set", "static", ","):
                continue  # a method of an object or class
            if language == "rust" and w[0].isupper() and t.at(t.partner[i + 1] + 1) in ("=", "=>", "|"):
                continue  # a pattern
            line = t.line[i]
            j = i
            while t.at(j - 1) in (".", "::", "->") and j >= 2:  # a call begins where its object does
                j = t.partner[j - 2] if t.at(j - 2) in (")", "]") and t.partner[j - 2] > 0 else j - 2
                line = t.line[j]
                if t.at(j) in ("(", "[") and not t.is_name(j - 1):
                    break
                if t.at(j) in ("(", "["):
                    j -= 1
                    line = t.line[j]
            out.call(caller, w, line)


def _after_new(t: Tokens, i: int) -> bool:
    while t.at(i - 1) in (".", "::") and t.is_name(i - 2):
        i -= 2
    return t.at(i - 1) == "new"


def _qualified_new(t: Tokens, i: int) -> bool:
    return t.at(i - 1) == "." and _after_new(t, i)


def _past_angles(t: Tokens, i: int) -> int:
    """The token after a balanced <...> that begins at i, or i."""
    if t.at(i) != "<":
        return i
    depth = 0
    for j in range(i, min(i + 200, len(t))):
        w = t.at(j)
        depth += (w == "<") - (w == ">")
        if w in (";", "{", "}") or depth == 0:
            return j + 1 if depth == 0 else i
    return i


def _member_end(t: Tokens, i: int, hi: int) -> tuple[int, int]:
    """From i on, the first ; or { outside brackets, and where the member ends."""
    j = i
    while j < hi:
        w = t.at(j)
        if w == ";":
            return j, j
        if w == "{":
            return j, t.partner[j]
        if w in ("(", "["):
            j = max(j, t.partner[j])
        if w == "}":
            return j, j
        j += 1
    return hi, hi - 1


# --- JavaScript and TypeScript


def _script(t: Tokens, out: Found, language: str) -> None:
    def block(i: int, hi: int, parent: int | None, in_class: bool) -> None:
        while i < hi:
            w = t.at(i)
            if in_class and (t.is_name(i) or w in ("#", "[")) and w not in ("static", "async", "get", "set", "public", "private", "protected", "readonly", "override", "abstract"):
                j = i + 1 if w == "#" else i
                name = ("#" if w == "#" else "") + t.at(j)
                k = _past_angles(t, j + 1)
                if t.at(k) == "(":
                    b, z = _member_end(t, t.partner[k] + 1, hi)
                    if t.at(b) == "{":
                        first = i
                        while t.at(first - 1) in ("static", "async", "get", "set", "public", "private", "protected", "override", "*") and t.line[first - 1] <= t.line[i]:
                            first -= 1
                        s = out.symbol(name, "method", t.line[first], t.line[z], parent)
                        _calls(t, k, z, s, out, language)
                    i = z + 1
                    continue
                b, z = _field_end(t, i, hi)
                i = z + 1
                continue
            if w == "function" and (t.is_name(i + 1) or t.at(i + 1) == "*" and t.is_name(i + 2)):
                j = i + 2 if t.at(i + 1) == "*" else i + 1
                b, z = _member_end(t, _past_angles(t, j + 1), hi)
                if t.at(b) == "{" and t.at(i - 1) not in ("=", "(", ",", ":", "return", "=>"):
                    s = out.symbol(t.at(j), "function", t.line[i], t.line[z], parent, f"function {t.at(j)}")
                    _calls(t, j + 1, z, s, out, language)
                    block(b + 1, z, s, False)
                    i = z + 1
                    continue
            elif w == "class" and t.is_name(i + 1) and t.at(i + 1) != "extends" and t.at(i - 1) not in ("=", "(", ",", "return", "."):
                b, z = _member_end(t, i + 2, hi)
                if t.at(b) == "{":
                    block(b + 1, z, out.symbol(t.at(i + 1), "class", t.line[i], t.line[z], parent), True)
                    i = z + 1
                    continue
            elif w in ("const", "let", "var") and t.at(i - 1) != ".":
                i = variables(i, hi, parent)
                continue
            elif w == "import" and t.at(i + 1) not in ("(", "."):
                i = imported(i, hi)
                continue
            elif parent is None and w == "import" and t.at(i + 1) == "(" and t.at(i + 2).endswith("…"):
                out.use(t.raw(i + 2, i + 2).strip("'\"`"))
            elif w == "export" and t.at(i + 1) in ("{", "*", "type"):
                i = exported(i, hi)
                continue
            i += 1

    def variables(i: int, hi: int, parent: int | None) -> int:
        depth_end = _statement_end(t, i, hi)
        j = i + 1
        while j < depth_end:
            if t.is_name(j) and t.at(j - 1) in ("const", "let", "var", ","):
                k = j + 1
                if t.at(k) == ":":  # a type annotation
                    while k < depth_end and t.at(k) not in ("=", ","):
                        k = t.partner[k] + 1 if t.at(k) in ("(", "[", "{") else k + 1
                if t.at(k) == "=":
                    v = k + 2 if t.at(k + 1) == "async" else k + 1
                    a = _past_angles(t, v)
                    arrow = t.is_name(a) and t.at(a + 1) == "=>"
                    if t.at(a) == "(":
                        p = t.partner[a] + 1
                        if t.at(p) == ":":
                            while p < depth_end and t.at(p) not in ("=>", ";"):
                                p = t.partner[p] + 1 if t.at(p) in ("(", "[", "{") else p + 1
                        arrow = t.at(p) == "=>"
                    if arrow:
                        s = out.symbol(t.at(j), "function", t.line[i], t.line[depth_end - 1 if t.at(depth_end) != ";" else depth_end], parent, f"const {t.at(j)}")
                        _calls(t, v, depth_end, s, out, language)
            if t.at(j) == "import" and t.at(j + 1) == "(" and t.at(j + 2).endswith("…") and parent is None:
                out.use(t.raw(j + 2, j + 2).strip("'\"`"))
            j = t.partner[j] + 1 if t.at(j) in ("(", "[", "{") and t.partner[j] > j else j + 1
        return depth_end + 1 if t.at(depth_end) == ";" else depth_end

    def imported(i: int, hi: int) -> int:
        j, names = i + 1, []
        while j < hi and not t.at(j).endswith("…") and t.at(j) not in (";", "("):
            if t.at(j) == "{":
                names += [t.at(k) for k in range(j + 1, t.partner[j]) if t.is_name(k) and t.at(k - 1) in ("{", ",", "type") and t.at(k) != "type"]
                j = t.partner[j]
            elif t.at(j) == "*":
                j += 2
            elif t.is_name(j) and t.at(j) not in ("from", "type", "as"):
                names.append(t.at(j))
            j += 1
        if t.at(j).endswith("…"):
            out.use(t.raw(j, j).strip("'\""), names)
        return j + 1

    def exported(i: int, hi: int) -> int:
        j, names = i + 1, []
        if t.at(j) == "type":
            j += 1
        if t.at(j) == "{":
            z = t.partner[j]
            for k in range(j + 1, z):
                if t.is_name(k) and t.at(k + 1) in (",", "}") and k < z:
                    names.append(t.at(k))
            j = z + 1
        elif t.at(j) == "*":
            j += 3 if t.at(j + 1) == "as" else 1
        else:
            return i + 1
        if t.at(j) == "from" and t.at(j + 1).endswith("…"):
            out.use(t.raw(j + 1, j + 1).strip("'\""), names)
            return j + 2
        return j

    block(0, len(t), None, False)


def _statement_end(t: Tokens, i: int, hi: int) -> int:
    """The ; that ends a statement, or the first token of the next line's statement."""
    j = i + 1
    while j < hi:
        w = t.at(j)
        if w == ";":
            return j
        if w in ("(", "[", "{"):
            j = max(t.partner[j], j) + 1
            if j < hi and t.line[j] > t.line[j - 1] and t.at(j - 1) in ("}", ")", "]") and (t.is_name(j) or t.at(j) in ("}", "@")):
                return j
            continue
        if w == "}":
            return j
        if t.line[j] > t.line[j - 1] and t.is_name(j) and (t.is_name(j - 1) or t.at(j - 1).endswith("…") or t.at(j - 1)[0].isdigit()):
            return j
        j += 1
    return hi


def _field_end(t: Tokens, i: int, hi: int) -> tuple[int, int]:
    j = _statement_end(t, i, hi)
    return j, j if t.at(j) == ";" else j - 1 if j > i + 1 else i


# --- Rust


def _rust(t: Tokens, out: Found, language: str) -> None:
    def block(i: int, hi: int, parent: int | None) -> None:
        while i < hi:
            w = t.at(i)
            first = i
            while t.at(first - 1) in ("pub", "async", "unsafe", "const", "extern", ")") or t.at(first - 1).endswith("…") and t.at(first - 2) == "extern":
                if t.at(first - 1) == ")":
                    if t.at(t.partner[first - 1] - 1) != "pub":
                        break
                    first = t.partner[first - 1]
                first -= 1
            if w == "fn" and t.is_name(i + 1):
                p = _past_angles(t, i + 2)
                if t.at(p) != "(":
                    i += 1
                    continue
                b, z = _member_end(t, t.partner[p] + 1, hi)
                if t.at(b) == "{":
                    r = next((k for k in range(t.partner[p] + 1, b) if t.at(k) == "where"), b)
                    ret = f" -> {t.raw(t.partner[p] + 2, r - 1)}" if t.at(t.partner[p] + 1) == "->" else ""
                    s = out.symbol(t.at(i + 1), "function" if parent is None else "method", t.line[first], t.line[z], parent, f"fn {t.at(i + 1)}{t.raw(p, t.partner[p])}{ret}")
                    _calls(t, i + 2, z, s, out, "rust")
                i = z + 1
            elif w in ("struct", "enum") and t.is_name(i + 1):
                _, z = _member_end(t, i + 2, hi)
                out.symbol(t.at(i + 1), w, t.line[first], t.line[min(z, len(t) - 1)], parent)
                i = z + 1
            elif w == "trait" and t.is_name(i + 1):
                b, z = _member_end(t, i + 2, hi)
                block(b + 1, z, out.symbol(t.at(i + 1), "trait", t.line[first], t.line[z], parent))
                i = z + 1
            elif w == "impl":
                b, z = _member_end(t, i + 1, hi)
                a = _past_angles(t, i + 1)
                a = next((k + 1 for k in range(a, b) if t.at(k) == "for"), a)
                e = next((k for k in range(a, b) if t.at(k) == "where"), b)
                block(b + 1, z, out.first(t.raw(a, e - 1), "struct", "enum"))
                i = z + 1
            elif w == "use" and (i == 0 or t.at(i - 1) in (";", "}", "{", "pub", ")", "]")):
                j = i
                while j < hi and t.at(j) != ";":
                    j = t.partner[j] + 1 if t.at(j) == "{" else j + 1
                if t.at(i - 1) not in ("pub", ")"):
                    out.use(t.raw(i + 1, j - 1).strip())
                i = j + 1
            else:
                i += 1

    block(0, len(t), None)


# --- Go


def _go(t: Tokens, out: Found, language: str) -> None:
    i = 0
    while i < len(t):
        w = t.at(i)
        top = True
        if w == "func" and (t.is_name(i + 1) or t.at(i + 1) == "("):
            receiver = None
            j = i + 1
            if t.at(j) == "(":
                receiver, j = (j, t.partner[j]), t.partner[j] + 1
            if t.is_name(j):
                p = t.partner[j + 1] + 1 if t.at(j + 1) == "[" else j + 1
                if t.at(p) == "(":
                    close = t.partner[p]
                    b = close + 1
                    while b < len(t) and t.at(b) != "{" and (t.line[b] == t.line[b - 1] or t.at(b - 1) == ","):
                        if t.at(b) in ("(", "[") or t.at(b) in ("struct", "interface"):
                            b = t.partner[b] + 1 if t.at(b) in ("(", "[") else t.partner[b + 1] + 1
                        else:
                            b += 1
                    z = t.partner[b] if t.at(b) == "{" else b - 1
                    ret = f" {t.raw(close + 1, b - 1)}" if b > close + 1 else ""
                    parent, head = None, ""
                    if receiver:
                        head = f"{t.raw(*receiver)} "
                        named = [t.at(k) for k in range(receiver[0] + 1, receiver[1]) if t.is_name(k)]
                        base = next((k for k in range(receiver[0] + 1, receiver[1]) if t.at(k) == "["), receiver[1])
                        named = [t.at(k) for k in range(receiver[0] + 1, base) if t.is_name(k)]
                        parent = out.first(named[-1], "struct", "interface") if named else None
                    s = out.symbol(t.at(j), "method" if receiver else "function", t.line[i], t.line[z], parent, f"func {head}{t.at(j)}{t.raw(p, close)}{ret}")
                    if t.at(b) == "{":
                        _calls(t, b, z, s, out, "go")
                    i = z + 1
                    continue
        elif w == "type" and (t.is_name(i + 1) or t.at(i + 1) == "("):
            specs = [(i + 1, len(t))] if t.at(i + 1) != "(" else []
            k, hi = (i + 2, t.partner[i + 1]) if t.at(i + 1) == "(" else (0, 0)
            while k < hi:
                specs.append((k, hi))
                line = t.line[k]
                while k < hi and t.line[k] == line:
                    k = t.partner[k] + 1 if t.at(k) in ("{", "(", "[") else k + 1
                    line = t.line[k - 1]
            for a, _ in specs:
                b = a + 1
                if t.at(b) == "[" and t.is_name(b + 1) and t.is_name(b + 2):
                    b = t.partner[b] + 1
                b += t.at(b) == "="
                kind = t.at(b) if t.at(b) in ("struct", "interface") else "type"
                z = t.partner[b + 1] if kind != "type" and t.at(b + 1) == "{" else b
                while kind == "type" and z + 1 < len(t) and t.line[z + 1] == t.line[z]:
                    z = t.partner[z + 1] if t.at(z + 1) in ("{", "(", "[") else z + 1
                if b > a and not (kind == "type" and t.at(a + 1) == "="):
                    out.symbol(t.at(a), kind, t.line[a], t.line[z])
                top = False
                i = max(i, z)
            i += 1
            continue
        elif w == "import":
            hi = t.partner[i + 1] if t.at(i + 1) == "(" else i + 3
            for k in range(i + 1, min(hi + 1, len(t))):
                if t.at(k).endswith("…") and (t.at(i + 1) == "(" or t.line[k] == t.line[i]):
                    out.use(t.raw(k, k).strip('"`'))
            i = hi if t.at(i + 1) == "(" else i + 1
        i = t.partner[i] + 1 if t.at(i) in ("{", "(") and top and t.partner[i] > i else i + 1


# --- Java and C#


def _java(t: Tokens, out: Found, language: str) -> None:
    def body(i: int, hi: int, parent: int | None) -> None:
        while i < hi:
            if t.at(i) in (";", "}", ","):
                i += 1
                continue
            if t.at(i) in ("import", "package") and parent is None:
                j = i
                while j < hi and t.at(j) != ";":
                    j += 1
                if t.at(i) == "import":
                    a = i + 2 if t.at(i + 1) == "static" else i + 1
                    e = j - 1
                    if t.at(e) == "*":
                        e -= 2
                    if e > a:
                        out.use("".join(t.text[a : e + 1]))
                i = j + 1
                continue
            i = member(i, hi, parent)

    def member(i: int, hi: int, parent: int | None) -> int:
        j = i
        while t.at(j) == "@" and t.at(j + 1) != "interface":  # annotations
            j += 2
            while t.at(j) == "." and t.is_name(j + 1):
                j += 2
            if t.at(j) == "(":
                j = t.partner[j] + 1
        k = j
        while k < hi and t.at(k) not in ("(", "{", ";", "=", "class", "interface", "enum"):
            k = max(_past_angles(t, k), k + 1) if t.at(k) == "<" else t.partner[k] + 1 if t.at(k) == "[" else k + 1
        w = t.at(k)
        if w in ("class", "interface", "enum") and t.is_name(k + 1):
            b, z = _member_end(t, k + 2, hi)
            s = out.symbol(t.at(k + 1), w, t.line[i], t.line[z], parent)
            if t.at(k - 1) == "@":
                out.symbols.pop()
                return z + 1
            if w == "enum":  # constants first, up to a ;
                semi = b + 1
                while semi < z and t.at(semi) != ";":
                    semi = t.partner[semi] + 1 if t.at(semi) in ("(", "{", "[") else semi + 1
                b = semi
            body(b + 1, z, s)
            return z + 1
        if w == "(" and t.is_name(k - 1):
            b, z = _member_end(t, t.partner[k] + 1, hi)
            mods = {"public", "private", "protected", "static", "final", "abstract", "synchronized", "native", "default", "strictfp"}
            a = j
            while a < k - 1 and t.at(a) in mods:
                a += 1
            a = _past_angles(t, a)
            name, params = t.at(k - 1), t.raw(k, t.partner[k])
            if a == k - 1:
                s = out.symbol(name, "constructor", t.line[i], t.line[z], parent, f"{name}{params}")
            else:
                s = out.symbol(name, "method", t.line[i], t.line[z], parent, f"{t.raw(a, k - 2)} {name}{params}")
            if t.at(b) == "{":
                _calls(t, b, z, s, out, "java")
            return z + 1
        if w == "{":
            return t.partner[k] + 1
        while k < hi and t.at(k) != ";":
            k = t.partner[k] + 1 if t.at(k) in ("(", "{", "[") else k + 1
        return k + 1

    body(0, len(t), None)


def _csharp(t: Tokens, out: Found, language: str) -> None:
    types = ("class", "struct", "interface", "enum", "record")
    mods = {"public", "private", "protected", "internal", "static", "readonly", "virtual", "override", "abstract", "sealed", "async", "extern", "new", "partial", "unsafe", "required", "const", "volatile"}

    def body(i: int, hi: int, parent: int | None) -> None:
        active = None
        while i < hi:
            if t.at(i) in (";", "}", ","):
                i += 1
                continue
            owner = parent if active is None else active
            if t.at(i) == "using" and t.at(i + 1) != "(" or t.at(i) == "global" and t.at(i + 1) == "using":
                j = i
                while j < hi and t.at(j) != ";":
                    j += 1
                a = next((k + 1 for k in range(i, j) if t.at(k) == "="), i + 1)
                while t.at(a) in ("static", "using", "unsafe"):
                    a += 1
                if a < j and "<" not in t.text[a:j]:
                    out.use("".join(t.text[a:j]))
                i = j + 1
            elif t.at(i) == "namespace":
                b = i + 1
                while b < hi and t.at(b) not in ("{", ";"):
                    b += 1
                name = "".join(t.text[i + 1 : b])
                if t.at(b) == ";":
                    active = out.symbol(name, "namespace", t.line[i], t.line[b], parent)
                    i = b + 1
                else:
                    z = t.partner[b]
                    body(b + 1, z, out.symbol(name, "namespace", t.line[i], t.line[z], owner))
                    i = z + 1
            else:
                i = member(i, hi, owner)

    def member(i: int, hi: int, parent: int | None) -> int:
        j = i
        while t.at(j) == "[":
            j = t.partner[j] + 1
        k = j
        while k < hi and t.at(k) not in ("(", "{", ";", "=", "=>") and not (t.at(k) in types and t.is_name(k + 1)):
            k = max(_past_angles(t, k), k + 1) if t.at(k) == "<" else t.partner[k] + 1 if t.at(k) == "[" else k + 1
        w = t.at(k)
        a = j
        while t.at(a) in mods:
            a += 1
        if w in types:
            n = k + 2 if w == "record" and t.at(k + 1) in ("class", "struct") else k + 1
            b, z = _member_end(t, n + 1, hi)
            s = out.symbol(t.at(n), w, t.line[i], t.line[z], parent)
            if t.at(b) == "{" and w != "enum":
                body(b + 1, z, s)
            return z + 1
        if w == "(" and parent is None and not t.is_name(k - 1) and t.at(k - 1) != ">":
            return t.partner[k] + 1
        if w == "(":
            n = k - 1
            if t.at(n) == ">":
                while n > j and t.at(n) != "<":
                    n -= 1
                n -= 1
            close = t.partner[k]
            b = close + 1
            while b < hi and t.at(b) not in ("{", ";", "=>"):
                b = t.partner[b] + 1 if t.at(b) in ("(", "[") else b + 1
            z = t.partner[b] if t.at(b) == "{" else b
            while t.at(b) == "=>" and z < hi and t.at(z) != ";":
                z = t.partner[z] + 1 if t.at(z) in ("(", "[", "{") else z + 1
            name, params = t.at(n), t.raw(k, close)
            if t.is_name(n):
                if a == n:
                    s = None if t.at(a - 1) == "~" else out.symbol(name, "constructor", t.line[i], t.line[min(z, len(t) - 1)], parent, f"{name}{params}")
                else:
                    s = out.symbol(name, "method", t.line[i], t.line[min(z, len(t) - 1)], parent, f"{t.raw(a, n - 1)} {name}{params}") if parent is not None else None
                if s is not None:
                    _calls(t, close + 1, z, s, out, "csharp")
            return z + 1
        if w in ("{", "=>") and t.is_name(k - 1) and k - 1 > a and "event" not in t.text[j:k]:
            z = t.partner[k] if w == "{" else k
            while w == "=>" and z < hi and t.at(z) != ";":
                z = t.partner[z] + 1 if t.at(z) in ("(", "[", "{") else z + 1
            if w == "{" and t.at(z + 1) == "=":
                while z < hi and t.at(z) != ";":
                    z = t.partner[z] + 1 if t.at(z) in ("(", "[", "{") and t.partner[z] > z else z + 1
            out.symbol(t.at(k - 1), "property", t.line[i], t.line[min(z, len(t) - 1)], parent, f"{t.raw(a, k - 2)} {t.at(k - 1)}")
            return z + 1
        if w == "{":
            return t.partner[k] + 1
        while k < hi and t.at(k) != ";":
            k = t.partner[k] + 1 if t.at(k) in ("(", "{", "[") else k + 1
        return k + 1

    body(0, len(t), None)


# --- C and C++

_STORAGE = {"static", "extern", "inline", "register", "constexpr", "virtual", "explicit", "friend", "typename", "consteval", "mutable", "_Noreturn", "const", "volatile"}


def _c(t: Tokens, out: Found, language: str) -> None:
    _c_block(t, 0, len(t), None, out, False)


def _cpp(t: Tokens, out: Found, language: str) -> None:
    _c_block(t, 0, len(t), None, out, True)


def _c_block(t: Tokens, i: int, hi: int, parent: int | None, out: Found, cpp: bool, in_class: bool = False) -> None:
    while i < hi:
        w = t.at(i)
        if w == "#" and (i == 0 or t.line[i] > t.line[i - 1]):
            line = t.line[i]
            if t.at(i + 1) == "include" and not in_class:
                m = re.match(r'\s*#\s*include\s*(?:"([^"\n]*)"|<([^>\n]*)>)', t.source[t.start[i] :])
                if m:
                    out.use(m[1] or m[2])
            end = t.start[i]
            while True:  # a directive goes on where its line ends in a backslash
                nl = t.source.find("\n", end)
                if nl < 0 or t.source[nl - 1] != "\\":
                    break
                end = nl + 1
            while i < hi and (t.line[i] == line or nl >= 0 and t.start[i] < nl):
                i += 1
            continue
        if w in (";", "}", ":") or in_class and w in ("public", "private", "protected"):
            i += 1
            continue
        if cpp and w == "template":
            i = _past_angles(t, i + 1)
            continue
        if w == "extern" and t.at(i + 1).endswith("…"):
            i += 3 if t.at(i + 2) == "{" else 2
            continue
        if cpp and w in ("namespace", "inline") and not in_class and (w == "namespace" or t.at(i + 1) == "namespace"):
            k = i if w == "namespace" else i + 1
            b, z = _member_end(t, k + 1, hi)
            if t.at(b) == "{":
                s = out.symbol("".join(t.text[k + 1 : b]), "namespace", t.line[i], t.line[z], parent) if b > k + 1 else parent
                _c_block(t, b + 1, z, s, out, cpp)
            i = z + 1
            continue
        if w == "typedef":
            j = i
            while j < hi and t.at(j) != ";":
                j = t.partner[j] + 1 if t.at(j) in ("{", "(", "[") else j + 1
            p = next((k for k in range(i, j) if t.at(k) == "(" and t.at(k + 1) == "*"), None)
            name = t.at(p + 2) if p is not None else next((t.at(k) for k in range(j - 1, i, -1) if t.is_name(k)), "")
            if name and not in_class:
                out.symbol(name, "type", t.line[i], t.line[min(j, len(t) - 1)])
            i = j + 1
            continue
        i = _c_declaration(t, i, hi, parent, out, cpp, in_class)


def _c_declaration(t: Tokens, i: int, hi: int, parent: int | None, out: Found, cpp: bool, in_class: bool) -> int:
    """One declaration from token i on; the token after it."""
    k = i
    while k < hi and t.at(k) not in ("(", "{", ";", "="):
        if t.at(k) == "operator":
            while k < hi and t.at(k) != "(" or t.at(k) == "(" and t.at(k + 1) == ")" and t.at(k - 1) == "operator":
                k += 2 if t.at(k) == "(" else 1
            break
        k = max(_past_angles(t, k), k + 1) if cpp and t.at(k) == "<" else t.partner[k] + 1 if t.at(k) == "[" else k + 1
    head = t.text[i:k]
    word = next((x for x in head if x in ("struct", "union", "enum", "class")), None)
    if t.at(k) == "{" and word:
        n = i + head.index(word) + 1
        n += word == "enum" and t.at(n) in ("class", "struct")
        z = t.partner[k]
        whole = t.at(z + 1) == ";" or cpp
        if t.is_name(n) and n < k and whole and not in_class:
            if word == "class" or cpp and word == "struct":
                s = out.symbol(t.at(n), word, t.line[i], t.line[z], parent)
                _c_block(t, k + 1, z, s, out, cpp, True)
            elif word != "union" or not cpp:
                out.symbol(t.at(n), word, t.line[i], t.line[z])
        while z < hi and t.at(z) != ";":
            z += 1
            if t.at(z) in ("(", "["):
                z = t.partner[z]
            if t.line[min(z, len(t) - 1)] > t.line[t.partner[k]] and t.at(z) != ";":
                return z
        return z + 1
    if t.at(k) == "(":
        close = t.partner[k]
        b = close + 1
        while b < hi and t.at(b) not in ("{", ";", "=", "}"):
            if t.at(b) == ":" and cpp:  # initialisers of a constructor
                b += 1
                while b < hi and t.at(b) not in ("{", ";"):
                    if t.at(b) == "(":
                        b = t.partner[b] + 1
                    elif t.at(b + 1) == "{" and t.is_name(b) and t.at(t.partner[b + 1] + 1) in (",", "{"):
                        b = t.partner[b + 1] + 1
                    else:
                        b += 1
                break
            b = t.partner[b] + 1 if t.at(b) in ("(", "[") else b + 1
        defaulted = cpp and t.at(b) == "=" and t.at(b + 1) in ("default", "delete")
        n = k - 1
        if t.at(b) == "{" or defaulted:
            z = t.partner[b] if t.at(b) == "{" else b + 2
            lo = n
            if "operator" in head:
                lo = i + head.index("operator")
                name = t.raw(lo, n)
            elif t.is_name(n):
                name = t.at(n)
                if cpp and t.at(n - 1) == "~":
                    lo, name = n - 1, "~" + name
            else:
                return z + 1
            while cpp and t.at(lo - 1) == "::":
                lo -= 2
                if t.at(lo) == ">":
                    while lo > i and t.at(lo) != "<":
                        lo -= 1
                    lo -= 1
            scope = t.at(n - 2 if name[0] != "~" else n - 3) if lo < n - 1 and t.at(lo + 1) in ("::", "<") else None
            a = i
            while t.at(a) in _STORAGE and a < lo:
                a += 1
            stars = lo
            while stars > a and t.at(stars - 1) in ("*", "&"):
                stars -= 1
            declarator = t.raw(stars, close)
            signature = f"{t.raw(a, stars - 1) if stars > a else 'void'} {declarator}"
            if in_class:
                kind, owner = "method", parent
            elif scope:
                owner = out.first(scope, "class", "struct")
                known = any(s["name"] == scope and s["kind"] == "namespace" for s in out.symbols)
                kind = "function" if owner is None and known else "method"
                owner = parent if owner is None else owner
            else:
                kind, owner = "function", parent
            s = out.symbol(name, kind, t.line[i], t.line[min(z, len(t) - 1)], owner, signature)
            _calls(t, b, z, s, out, "cpp" if cpp else "c")
            return z + 1
    j = k
    while j < hi and t.at(j) != ";":
        j = t.partner[j] + 1 if t.at(j) in ("(", "{", "[") and t.partner[j] > j else j + 1
    return j + 1
