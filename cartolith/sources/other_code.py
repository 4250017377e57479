"""Row generators over other languages: JavaScript and TypeScript, C and C++, HTML; and tokenizers.

Symbols are read from the nodes of `syntax`; the tokenizers keep strings and comments apart and give each token its
normal form.
"""

from __future__ import annotations

import builtins
import keyword
import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

from . import syntax

_TOKEN = {
    "python": re.compile(r"(?P<comment>\#[^\n]*)|(?P<string>[rbfuRBFU]{0,2}(?:'''[\s\S]*?'''|\"\"\"[\s\S]*?\"\"\"|'(?:\\.|[^'\\\n])*'|\"(?:\\.|[^\"\\\n])*\"))|(?P<number>\b\d[\w.]*)|(?P<word>[A-Za-z_]\w*)|(?P<newline>\n)|(?P<op>[-+*/%=<>!&|^~:]{1,3}|[()\[\]{},.;@])"),
    "c": re.compile(r"(?P<comment>//[^\n]*|/\*[\s\S]*?\*/|^[ \t]*\#[^\n]*)|(?P<string>R\"(?P<mark>[^()\\\s\"]{0,16})\([\s\S]*?\)(?P=mark)\"|[LuU8]{0,2}\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`)|(?P<number>\b\d[\w.']*)|(?P<word>[A-Za-z_$][\w$]*)|(?P<newline>\n)|(?P<op>[-+*/%=<>!&|^~?:]{1,3}|[()\[\]{},.;@#])", re.M),
    "script": re.compile(r"(?P<comment>//[^\n]*|/\*[\s\S]*?\*/)|(?P<string>\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`)|(?P<number>\b\d[\w.]*)|(?P<word>[A-Za-z_$][\w$]*)|(?P<newline>\n)|(?P<op>/=?|[-+*%=<>!&|^~?:]{1,3}|[()\[\]{},.;@#])"),
}
_PATTERN = re.compile(r"(?P<string>/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*)")
#: Words after which a slash begins a pattern.
_BEFORE_PATTERN = set("return typeof case in of delete void throw new else do instanceof await yield".split())
#: Words that keep their own hash.
_C_WORDS = set("if else for while do switch case default break continue return goto try catch throw new delete class struct enum union namespace template typename public private protected static const virtual using function var let async await export import from extends implements interface type".split())
#: Names of types that count as one.
_TYPES = {"python": set("int float str bool bytes list dict set tuple object type complex frozenset".split()), "c": set("int long short char float double void bool unsigned signed auto size_t string number boolean any never unknown".split())}
_BUILTIN = set(dir(builtins))


def _found(text: str, language: str) -> Iterator[re.Match]:
    """Matches in order. In scripts a slash that follows no value begins a pattern, which counts as a string."""
    if language != "script":
        yield from _TOKEN[language].finditer(text)
        return
    at, value = 0, False
    while m := _TOKEN["script"].search(text, at):
        if m.lastgroup == "op" and text[m.start()] == "/" and not value:
            m = _PATTERN.match(text, m.start()) or m
        yield m
        at = m.end()
        if m.lastgroup not in ("comment", "newline"):
            raw = m.group()
            value = raw in ")]}" if m.lastgroup == "op" else raw not in _BEFORE_PATTERN


def tokens(path: str, text: str, language: str) -> Iterator[dict]:
    """Tokens with their line and normal form: names, strings, numbers and types become placeholders; comments go.

    In Python, lines that import and docstrings go as well. Languages: python, javascript and typescript (or script); others are read as C.
    """
    python = language == "python"
    kin = "python" if python else "script" if language in ("script", "javascript", "typescript") else "c"
    line, skip, fresh = 1, False, True
    for m in _found(text, kin):
        kind, raw = m.lastgroup, m.group()
        here = line
        line += raw.count("\n")
        if kind == "newline":
            skip, fresh = False, True
            continue
        if kind == "comment":
            continue
        if python and fresh and kind == "word" and raw in ("import", "from"):
            skip = True
        if python and fresh and kind == "string":
            continue
        fresh = False
        if skip:
            continue
        if kind == "word":
            words = set(keyword.kwlist) if python else _C_WORDS
            normal = raw if raw in words else "$TYPE" if raw in _TYPES["python" if python else "c"] else "$ID"
        else:
            normal = {"string": "$STR", "number": "$NUM"}.get(kind, raw)
        yield {"path": path, "token": raw, "normal": normal, "line": here}


TOKEN_SCHEMA = "path string, token string, normal string, line int"
SYMBOL_SCHEMA = "path string, name string, kind string, lineno int, parent string, complexity int"


def _symbol_rows(nodes: Iterator[dict]) -> Iterator[dict]:
    for row in nodes:
        if row["kind"] in ("class", "function", "method"):
            parent = row["owner"] if row["kind"] == "method" else None
            yield {"path": row["path"], "name": row["name"], "kind": row["kind"], "lineno": row["line"], "parent": parent, "complexity": row["complexity"]}


def script_symbols(path: str, text: str) -> Iterator[dict]:
    """Functions, named arrow functions, classes and methods of JavaScript or TypeScript."""
    yield from _symbol_rows(syntax.script_nodes(path, text))


def native_symbols(path: str, text: str) -> Iterator[dict]:
    """Functions, methods, classes, structs, enums and typedefs of C or C++."""
    yield from _symbol_rows(syntax.native_nodes(path, text))


class _Elements(HTMLParser):
    def __init__(self):
        super().__init__()
        self.found: list[tuple[str, str | None, int]] = []

    def handle_starttag(self, tag: str, attrs) -> None:
        ident = dict(attrs).get("id")
        if ident:
            self.found.append((ident, tag, self.getpos()[0]))
        elif "-" in tag:
            self.found.append((tag, None, self.getpos()[0]))

    handle_startendtag = handle_starttag


def html_elements(path: str, text: str) -> Iterator[dict]:
    """Elements with an id, under their tag, and custom elements."""
    parser = _Elements()
    parser.feed(text)
    yield from ({"path": path, "name": n, "kind": "element", "lineno": line, "parent": p, "complexity": None} for n, p, line in parser.found)


def plain_text(path: str, text: str) -> Iterator[dict]:
    """No symbols."""
    return iter(())


def generator_for(path: str):
    """The generator of a file's extension; files of no known language have no symbols."""
    from . import python_code

    suffix = path.rpartition(".")[2].lower() if "." in path else ""
    if suffix in ("py", "pyw", "pyi"):
        return lambda p, t: ({k: r[k] for k in ("path", "name", "kind", "lineno", "parent", "complexity")} for r in python_code.symbols(p, t))
    if suffix in ("js", "jsx", "mjs", "cjs", "ts", "tsx"):
        return script_symbols
    if suffix in ("c", "h", "cc", "cpp", "cxx", "hh", "hpp", "hxx"):
        return native_symbols
    return html_elements if suffix in ("html", "htm") else plain_text


def any_symbols(path: str, text: str) -> Iterator[dict]:
    """Symbols of a file by the generator of its extension."""
    yield from generator_for(path)(path, text)


def with_overrides(overrides: dict[str, Callable[[str, str], Iterator[dict]]]) -> Callable[[str, str], Iterator[dict]]:
    """any_symbols with other generators for some extensions, with or without their dot, in any case."""
    own = {"." + extension.lower().removeprefix("."): generator for extension, generator in overrides.items()}

    def run(path: str, text: str) -> Iterator[dict]:
        suffix = "." + path.rpartition(".")[2].lower() if "." in path else ""
        yield from own.get(suffix, any_symbols)(path, text)

    return run
