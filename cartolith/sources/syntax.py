"""A table of syntax nodes of script languages (JavaScript, TypeScript) and native ones (C, C++).

A file's text becomes tokens with matched brackets, and a descent over them gives one row for each declaration, call,
decision, import and export, with the node it stands in. Errors are local: an unmatched bracket closes with the next
enclosing one, and what fits no declaration is read as an expression. Symbols, calls and complexity are queries on the rows.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

NODE_SCHEMA = (
    "path string, id int, parent int, function int, kind string, name string, owner string, scope string, receiver string, how string, source string, alias string, exported boolean, "
    "line int, end_line int, complexity int, doc string"
)

_PIECE = {
    True: re.compile(r"(?P<comment>//[^\n]*|/\*[\s\S]*?(?:\*/|\Z))|(?P<string>\"(?:\\[\s\S]|[^\"\\\n])*\"?|'(?:\\[\s\S]|[^'\\\n])*'?)|(?P<number>\d[\w.]*)|(?P<word>[A-Za-z_$ª-￿#][\w$]*)|(?P<op>=>|\?\.(?!\d)|\?\?|&&|\|\||\.\.\.|[^\s\w])"),
    False: re.compile(r"(?P<comment>//[^\n]*|/\*[\s\S]*?(?:\*/|\Z))|(?P<pre>^[ \t]*\#(?:\\\n|[^\n])*)|(?P<string>R\"(?P<mark>[^()\\\s\"]{0,16})\([\s\S]*?\)(?P=mark)\"|(?:u8|[LuU])?\"(?:\\[\s\S]|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])+')|(?P<number>\d[\w.']*)|(?P<word>[A-Za-z_]\w*)|(?P<op>->|::|&&|\|\||[^\s\w])", re.M),
}
_PATTERN = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[A-Za-z]*")
_CLOSES = {")": "(", "]": "[", "}": "{"}
#: Words after which a slash begins a pattern, and those whose parentheses are followed by a statement.
_NO_VALUE = frozenset("return typeof case in of delete void throw new else do instanceof await yield".split())
_HEADS = frozenset("if while for with".split())
#: What counts as a decision. A `do` counts for itself and not for its `while`.
_DECIDING = frozenset("if for while do case catch".split())
_SCRIPT_WORDS = frozenset("if for while switch catch function return with typeof await super do else case throw delete new in of instanceof void yield import".split())
_NATIVE_WORDS = frozenset("if for while switch catch return sizeof alignof decltype static_assert do else case throw delete new noexcept defined typeid co_await co_yield co_return".split())
_MODIFIERS = frozenset("public private protected static async readonly abstract override get set declare accessor".split())
_AFTER_PARAMETERS = frozenset("const noexcept override final volatile try mutable".split())
_RECORDS = frozenset("class struct union enum".split())


class _Tokens:
    """Kinds, texts and places of tokens, what each open bracket is closed by, and comments by the line they end on."""

    def __init__(self, text: str, script: bool):
        self.text, self.script = text, script
        self.kind: list[str] = []
        self.value: list[str] = []
        self.at: list[int] = []
        self.closed: dict[int, int] = {}
        self.opened: dict[int, int] = {}
        self.comments: dict[int, tuple[int, str]] = {}
        self.breaks = [m.start() for m in re.finditer("\n", text)]
        self._read()
        self.n = len(self.kind)

    def line(self, offset: int) -> int:
        return bisect.bisect_left(self.breaks, offset) + 1

    def _add(self, kind: str, value: str, at: int, stack: list[int]) -> None:
        index = len(self.kind)
        self.kind.append(kind)
        self.value.append(value)
        self.at.append(at)
        if kind != "op":
            return
        if value in "([{":
            stack.append(index)
        elif value in _CLOSES and any(self.value[k] == _CLOSES[value] for k in stack):
            while stack:  # brackets that were never closed end here
                k = stack.pop()
                self.closed[k] = index
                if self.value[k] == _CLOSES[value]:
                    self.opened[index] = k
                    break

    def _is_value(self) -> bool:
        """Whether a slash after the last token divides."""
        if not self.kind:
            return False
        kind, value = self.kind[-1], self.value[-1]
        if kind == "op":
            if value == ")":
                before = self.opened.get(len(self.kind) - 1, 0) - 1
                return not (before >= 0 and self.value[before] in _HEADS)
            return value in "]}"
        return kind != "word" or value not in _NO_VALUE

    def _read(self) -> None:
        text, piece, at, stack, templates = self.text, _PIECE[self.script], 0, [], []
        while m := piece.search(text, at):  # what lies before is space or no token
            at = m.start()
            if text[at] == "`" and self.script:
                self._add("string", "`", at, stack)
                at = self._template(at + 1, stack, templates)
                continue
            if text[at] == "}" and templates and stack == templates[-1][0]:
                self._add("op", ")", at, templates.pop()[1])
                at = self._template(at + 1, stack, templates)
                continue
            if m.lastgroup == "op" and m[0] == "/" and self.script and not self._is_value():
                pattern = _PATTERN.match(text, at)
                if pattern:
                    self._add("string", pattern[0], at, stack)
                    at = pattern.end()
                    continue
            if m.lastgroup == "comment":
                self.comments[self.line(m.end() - 1)] = (m.start(), m[0])
            else:
                self._add(m.lastgroup if m.lastgroup != "mark" else "string", m[0], at, stack)
            at = m.end()
        for k in stack:  # a stray parenthesis holds nothing, an open block all that follows
            self.closed[k] = len(self.kind) if self.value[k] == "{" else k

    def _template(self, at: int, stack: list[int], templates: list) -> int:
        """Goes on in a template string; an insertion in it is read as a parenthesis."""
        text = self.text
        while at < len(text):
            if text[at] == "\\":
                at += 2
            elif text[at] == "`":
                return at + 1
            elif text.startswith("${", at):
                self._add("op", "(", at, stack)
                templates.append((list(stack), stack))
                return at + 2
            else:
                at += 1
        return at


class _Reader:
    """What both families of languages share: rows, brackets, chains of names before a call, decisions."""

    def __init__(self, path: str, text: str, script: bool):
        self.path, self.t = path, _Tokens(text, script)
        self.value, self.kind, self.closed = self.t.value, self.t.kind, self.t.closed
        self.rows: list[dict] = []
        self.no_decision: set[int] = set()

    def add(self, kind: str, name: str | None, at: int, parent: tuple, **more) -> int:
        node, function, owner, scope = parent
        line = self.t.line(self.t.at[at]) if at < self.t.n else 1
        row = {"path": self.path, "id": len(self.rows), "parent": node, "function": function, "kind": kind, "name": name, "owner": owner, "scope": scope, "line": line, "end_line": line}
        self.rows.append(row | dict.fromkeys(("receiver", "how", "source", "alias", "exported", "complexity", "doc")) | more)
        return len(self.rows) - 1

    def close(self, node: int, last: int) -> None:
        """Ends a declaration at token `last` and counts the decisions in it."""
        row = self.rows[node]
        if last >= self.t.n:
            row["end_line"] = len(self.t.breaks) + 1
        else:
            row["end_line"] = self.t.line(self.t.at[last])
        if row["kind"] in ("function", "method"):
            row["complexity"] = 1 + sum(r["kind"] == "decision" for r in self.rows[node + 1 :])

    def doc(self, at: int) -> str | None:
        """The comment that ends at most three lines above, with nothing but empty lines between."""
        first = self.t.line(self.t.at[at])
        lines = self.t.text.splitlines()
        for line in range(first - 1, max(0, first - 4), -1):
            if line in self.t.comments:
                start, text = self.t.comments[line]
                if self.t.text[: start].rpartition("\n")[2].strip():
                    return None
                return " ".join(p for p in (part.strip().strip("/*").strip() for part in text.splitlines()) if p)
            if line - 1 < len(lines) and lines[line - 1].strip():
                return None
        return None

    def is_(self, i: int, value: str) -> bool:
        return 0 <= i < self.t.n and self.value[i] == value and self.kind[i] != "string"

    def word(self, i: int) -> bool:
        return 0 <= i < self.t.n and self.kind[i] == "word"

    def after(self, i: int) -> int:
        """The token after the bracket that opens at i."""
        return self.closed.get(i, self.t.n - 1) + 1

    def angles(self, i: int) -> int | None:
        """The token after type arguments that begin at i, or None if these are comparisons."""
        depth = 0
        while i < self.t.n:
            v = self.value[i]
            if self.kind[i] == "op":
                if v == "<":
                    depth += 1
                elif v == ">":
                    depth -= 1
                    if not depth:
                        return i + 1
                elif v in "([{":
                    i = self.closed.get(i, self.t.n)
                elif v in (";", ")", "]", "}", "&&", "||", "+", "-", "/"):
                    return None
            i += 1
        return None

    def decision(self, i: int, parent: tuple) -> None:
        v = self.value[i]
        if self.kind[i] == "word":
            if v in _DECIDING and i not in self.no_decision and not self.is_(i - 1, "."):
                self.add("decision", v, i, parent)
                if v == "do" and self.is_(i + 1, "{"):
                    self.no_decision.add(self.after(i + 1))
        elif v in ("&&", "||") or (v == "?" and not (i + 1 < self.t.n and self.value[i + 1] in (":", ")", ",", "=", ";"))):
            self.add("decision", v, i, parent)

    def receiver(self, i: int, joints: tuple[str, ...]) -> tuple[str | None, str | None]:
        """The dotted names before the name at i, and the joint next to it; calls and indices within are passed over."""
        parts: list[str] = []
        first = None
        while i > 0 and self.kind[i - 1] == "op" and self.value[i - 1] in joints:
            first = first or self.value[i - 1]
            i -= 2
            while i >= 0 and self.value[i] in (")", "]") and self.kind[i] == "op" and i in self.t.opened:
                i = self.t.opened[i] - 1
            if i >= 0 and self.kind[i] == "op" and self.value[i] == ">":  # type arguments
                depth = 0
                while i >= 0:
                    depth += (self.value[i] == ">") - (self.value[i] == "<")
                    i -= 1
                    if not depth:
                        break
            if not self.word(i):
                break
            parts.append(self.value[i])
        return ("::" if first == "::" else ".").join(reversed(parts)) or None, first


class _Script(_Reader):
    def __init__(self, path: str, text: str):
        super().__init__(path, text, True)
        self.block(0, self.t.n, (None, None, None, None))

    def block(self, i: int, end: int, parent: tuple) -> None:
        """Statements and expressions from i to end."""
        exported = False
        while i < end:
            v, was = self.value[i], exported
            exported = False
            if self.kind[i] != "word":
                if self.kind[i] == "op":
                    self.decision(i, parent)
                i += 1
            elif self.is_(i - 1, ".") or self.is_(i - 1, "?."):
                i = self.name(i, parent)
            elif v == "import":
                i = self.imports(i, parent)
            elif v == "export":
                exported, i = True, self.exports(i, parent)
            elif v in ("default", "async", "declare", "abstract"):
                exported, i = was, i + 1
            elif v == "function":
                i = self.function(i, parent, was)
            elif v == "class" and (self.word(i + 1) or self.is_(i + 1, "{")):
                i = self.record(i, parent, was)
            elif v in ("interface", "enum") and self.word(i + 1):
                while i < end and not self.is_(i, "{"):
                    i += 1
                i = self.after(i)
            elif v in ("namespace", "module") and self.word(i + 1) and (self.is_(i + 2, "{") or self.is_(i + 2, ".")):
                j = i + 1
                while j < end and not self.is_(j, "{"):
                    j += 1
                node = self.add("namespace", "".join(self.value[i + 1 : j]), i, parent, exported=was)
                self.block(j + 1, self.closed.get(j, end), (node, parent[1], parent[2], self.rows[node]["name"]))
                self.close(node, self.closed.get(j, end))
                i = self.after(j)
            elif v in ("const", "let", "var"):
                i = self.variables(i + 1, end, parent, was)
            elif v == "new":
                i = self.constructed(i, parent)
            else:
                i = self.name(i, parent)

    def parameters(self, i: int) -> int | None:
        """Where the parameters of a function begin, type parameters being passed over."""
        if self.is_(i, "<"):
            i = self.angles(i) or i
        return i if self.is_(i, "(") else None

    def body(self, i: int) -> int | None:
        """The brace that opens a body after parameters and a return type; None if there is none."""
        if self.is_(i, ":"):
            i += 1
            while i < self.t.n and not (self.is_(i, "{") and not self.is_(i - 1, ":") and not self.is_(i - 1, "|") and not self.is_(i - 1, "&")):
                if self.kind[i] == "op" and self.value[i] in (";", ",", ")", "}", "="):
                    return None
                i = (self.angles(i) or i + 1) if self.is_(i, "<") else self.after(i) if self.value[i] in ("(", "[", "{") and self.kind[i] == "op" else i + 1
        return i if self.is_(i, "{") else None

    def declared(self, name: str, kind: str, at: int, open_: int, parent: tuple, exported: bool, how: str | None = None) -> int:
        """A function whose parameters open at `open_`; returns the token after its body."""
        node = self.add(kind, name, at, parent, exported=exported, doc=self.doc(at), how=how)
        inside = (node, node, parent[2], parent[3])
        self.block(open_ + 1, self.closed.get(open_, self.t.n), inside)
        brace = self.body(self.after(open_))
        if brace is None:  # a signature
            self.close(node, min(self.after(open_), self.t.n) - 1)
            return self.after(open_)
        self.block(brace + 1, self.closed.get(brace, self.t.n), inside)
        self.close(node, self.closed.get(brace, self.t.n))
        return self.after(brace)

    def function(self, i: int, parent: tuple, exported: bool) -> int:
        j = i + 1 + self.is_(i + 1, "*")
        named = self.word(j)
        open_ = self.parameters(j + named)
        if open_ is None:
            return i + 1
        if named and not (self.kind[i - 1] == "op" and i and self.value[i - 1] in ("=", "(", ",", ":", "=>")):
            return self.declared(self.value[j], "function", i, open_, parent, exported)
        if self.is_(i - 1, "default") or (self.is_(i - 1, "async") and self.is_(i - 2, "default")):
            return self.declared("default", "function", i, open_, parent, True)
        return open_  # an expression: its parts belong to what it stands in

    def arrow(self, i: int) -> tuple[int, int] | None:
        """(parameters, first token of the body) of an arrow function or function expression at i."""
        i += self.is_(i, "async")
        if self.is_(i, "function"):
            j = i + 1 + self.is_(i + 1, "*")
            open_ = self.parameters(j + self.word(j))
            brace = None if open_ is None else self.body(self.after(open_))
            return None if brace is None else (open_, brace)
        if self.word(i) and self.is_(i + 1, "=>"):
            return i, i + 2
        open_ = self.parameters(i)
        if open_ is None:
            return None
        j = self.after(open_)
        if self.is_(j, ":"):
            j += 1
            while j < self.t.n and not self.is_(j, "=>"):
                if self.kind[j] == "op" and self.value[j] in (";", ",", ")", "}", "="):
                    return None
                j = (self.angles(j) or j + 1) if self.is_(j, "<") else self.after(j) if self.kind[j] == "op" and self.value[j] in "([{" else j + 1
        return (open_, j + 1) if self.is_(j, "=>") else None

    def variables(self, i: int, end: int, parent: tuple, exported: bool) -> int:
        """Declarators; those that hold a function are functions of that name."""
        while i < end and self.word(i):
            name, at, j = self.value[i], i, i + 1
            if self.is_(j, ":"):
                while j < end and not (self.kind[j] == "op" and self.value[j] in ("=", ";", ",", ")")):
                    j = (self.angles(j) or j + 1) if self.is_(j, "<") else self.after(j) if self.kind[j] == "op" and self.value[j] in "([{" else j + 1
            found = self.arrow(j + 1) if self.is_(j, "=") else None
            if found is None:
                if exported:
                    self.add("variable", name, at, parent, exported=True)
                return j
            node = self.add("function", name, j + 1, parent, exported=exported, doc=self.doc(at), how="arrow")
            inside = (node, node, parent[2], parent[3])
            open_, body = found
            if self.is_(open_, "("):
                self.block(open_ + 1, self.closed.get(open_, end), inside)
            stop = self.closed.get(body, end) if self.is_(body, "{") else self.expression_end(body, end)
            self.block(body + self.is_(body, "{"), stop, inside)
            self.close(node, stop if self.is_(body, "{") else max(body, stop - 1))
            i = stop + self.is_(body, "{")
            if not self.is_(i, ","):
                return i
            i += 1
        return i

    def expression_end(self, i: int, end: int) -> int:
        while i < end:
            if self.kind[i] == "op":
                if self.value[i] in (";", ",", ")", "]", "}"):
                    return i
                if self.value[i] in "([{":
                    i = self.closed.get(i, end)
            if self.kind[i : i + 1] == ["word"] and self.value[i] in ("const", "let", "var", "function", "class", "export", "import", "interface", "type") and i and self.t.line(self.t.at[i]) > self.t.line(self.t.at[i - 1]):
                return i
            i += 1
        return end

    def record(self, i: int, parent: tuple, exported: bool) -> int:
        named = self.word(i + 1) and self.value[i + 1] not in ("extends", "implements")
        name = self.value[i + 1] if named else "default" if self.is_(i - 1, "default") else None
        j = i + 1
        while j < self.t.n and not self.is_(j, "{"):
            j = self.after(j) if self.is_(j, "(") else j + 1
        base = next((self.value[k + 1] for k in range(i, min(j, self.t.n - 1)) if self.is_(k, "extends")), None)
        node = self.add("class", name, i, parent, exported=exported, doc=self.doc(i), source=base)
        self.members(j + 1, self.closed.get(j, self.t.n), (node, None, name, parent[3]))
        self.close(node, self.closed.get(j, self.t.n))
        return self.after(j)

    def members(self, i: int, end: int, parent: tuple) -> None:
        while i < end:
            while i < end and (self.is_(i, "*") or (self.word(i) and self.value[i] in _MODIFIERS and not self.is_(i + 1, "(") and not self.is_(i + 1, "=") and not self.is_(i + 1, ":"))):
                i += 1
            if i >= end:
                return
            if self.is_(i, "@"):  # a decorator, perhaps with arguments
                i += 2
                while self.is_(i, "."):
                    i += 2
                i = self.after(i) if self.is_(i, "(") else i
                continue
            j = i + 1 + (self.is_(i + 1, "?") or self.is_(i + 1, "!"))
            open_ = self.parameters(j) if self.word(i) else None
            if open_ is not None:
                brace = self.body(self.after(open_))
                if brace is not None and brace < end:
                    i = self.declared(self.value[i], "method", i, open_, parent, False)
                else:
                    i = self.after(open_)
                continue
            if self.is_(j, "=") or self.is_(j, ":"):
                stop = self.field_end(j, end)
                self.block(j, stop, parent)
                i = stop + 1
                continue
            i = self.after(i) if self.kind[i] == "op" and self.value[i] in "([{" else i + 1

    def field_end(self, i: int, end: int) -> int:
        while i < end and not self.is_(i, ";"):
            closing = self.kind[i] == "op" and self.value[i] in "([{"
            j = self.after(i) if closing else i + 1
            if j < end and self.t.line(self.t.at[j]) > self.t.line(self.t.at[j - 1]) and (self.word(j) or self.is_(j, "@")) and not (self.kind[j - 1] == "op" and self.value[j - 1] in ("=", ",", ".", "=>", "|", "&", "&&", "||", "?", ":", "+")):
                return j - 1
            i = j
        return min(i, end)

    def constructed(self, i: int, parent: tuple) -> int:
        j = i + 1
        while self.word(j) and self.is_(j + 1, "."):
            j += 2
        if not self.word(j) or self.value[j] in ("class", "target"):
            return i + 1
        self.add("call", "".join(self.value[i + 1 : j + 1]), i, parent, how="constructor")
        return j + 1

    def name(self, i: int, parent: tuple) -> int:
        """A name: a call if arguments follow, a method of an object if a body follows those."""
        self.decision(i, parent)
        open_ = i + 1
        if self.is_(open_, "?.") and self.is_(open_ + 1, "("):
            open_ += 1
        elif self.is_(open_, "<"):
            open_ = self.angles(open_) or open_
        if not self.is_(open_, "(") or open_ <= i or (self.value[i] in _SCRIPT_WORDS and not self.is_(i - 1, ".")):
            return i + 1
        brace = self.body(self.after(open_))
        if brace is not None and i and self.value[i - 1] in ("{", ",", "get", "set", "*", "async") and self.value[i] not in _HEADS:
            return self.declared(self.value[i], "function", i, open_, parent, False, "object")
        receiver, joint = self.receiver(i, (".", "?."))
        self.add("call", self.value[i], i, parent, receiver=receiver, how="method" if joint else "direct")
        return i + 1 if open_ == i + 1 else open_

    def listed(self, i: int) -> Iterator[tuple[str, str]]:
        """(name, alias) of a list in braces."""
        end, j = self.closed.get(i, self.t.n), i + 1
        while j < end:
            j += self.is_(j, "type") and self.word(j + 1) and not self.is_(j + 1, "as")
            if self.kind[j] in ("word", "string"):
                renamed = self.is_(j + 1, "as") and j + 2 < end
                yield self.value[j].strip("'\""), self.value[j + 2 if renamed else j].strip("'\"")
                j += 2 * renamed
            j += 1

    def source_after(self, i: int) -> tuple[str | None, int]:
        if self.is_(i, "from") and i + 1 < self.t.n and self.kind[i + 1] == "string":
            return self.value[i + 1].strip("'\"`"), i + 2
        return None, i

    def imports(self, i: int, parent: tuple) -> int:
        if self.is_(i + 1, "("):
            if i + 2 < self.t.n and self.kind[i + 2] == "string":
                self.add("import", None, i, parent, source=self.value[i + 2].strip("'\"`"), how="dynamic")
            return i + 1
        if i + 1 < self.t.n and self.kind[i + 1] == "string":
            self.add("import", None, i, parent, source=self.value[i + 1].strip("'\"`"), how="effect")
            return i + 2
        names: list[tuple[str, str]] = []
        j = i + 1 + (self.is_(i + 1, "type") and not self.is_(i + 2, "from") and not self.is_(i + 2, ","))
        if self.word(j):
            names.append(("default", self.value[j]))
            j += 1 + self.is_(j + 1, ",")
        if self.is_(j, "*") and self.is_(j + 1, "as") and self.word(j + 2):
            names.append(("*", self.value[j + 2]))
            j += 3
        elif self.is_(j, "{"):
            names += self.listed(j)
            j = self.after(j)
        source, j = self.source_after(j)
        for name, alias in names if source else ():
            self.add("import", name, i, parent, source=source, alias=alias, how="named")
        return max(j, i + 1)

    def exports(self, i: int, parent: tuple) -> int:
        j = i + 1 + (self.is_(i + 1, "type") and (self.is_(i + 2, "{") or self.is_(i + 2, "*")))
        if self.is_(j, "*"):
            alias, j = (self.value[j + 2], j + 3) if self.is_(j + 1, "as") else (None, j + 1)
            source, j = self.source_after(j)
            self.add("export", "*", i, parent, source=source, alias=alias)
            return max(j, i + 1)
        if self.is_(j, "{"):
            names = list(self.listed(j))
            source, j = self.source_after(self.after(j))
            for name, alias in names:
                self.add("export", name, i, parent, source=source, alias=alias)
            return j
        if self.is_(j, "default"):
            k = j + 1 + (self.is_(j + 1, "async") or self.is_(j + 1, "abstract"))
            named = self.value[k + 1] if self.is_(k, "function") and self.word(k + 1) or self.is_(k, "class") and self.word(k + 1) else self.value[k] if self.word(k) and not self.is_(k, "function") and not self.is_(k, "class") and (self.is_(k + 1, ";") or k + 1 >= self.t.n or self.t.line(self.t.at[k + 1]) > self.t.line(self.t.at[k])) else None
            self.add("export", named or "default", i, parent, alias="default")
        return i + 1


class _Native(_Reader):
    def __init__(self, path: str, text: str):
        super().__init__(path, text, False)
        self.declarations(0, self.t.n, (None, None, None, None))

    def include(self, i: int, parent: tuple) -> None:
        m = re.match(r"[ \t]*#[ \t]*include[ \t]*([<\"])([^>\"]+)[>\"]", self.value[i])
        if m:
            self.add("import", None, i, parent, source=m[2], how="system" if m[1] == "<" else "named")

    def declarations(self, i: int, end: int, parent: tuple) -> None:
        while i < end:
            v = self.value[i]
            if self.kind[i] == "pre":
                self.include(i, parent)
                i += 1
            elif self.kind[i] != "word" and not (self.kind[i] == "op" and v in ("~", "::")):
                i = self.after(i) if self.is_(i, "{") or self.is_(i, "(") or self.is_(i, "[") else i + 1
            elif v == "namespace":
                j = i + 1
                while j < end and not self.is_(j, "{") and not self.is_(j, ";"):
                    j += 1
                if not self.is_(j, "{"):
                    i = j + 1
                    continue
                name = "".join(x for x in self.value[i + 1 : j]) or None
                node = self.add("namespace", name, i, parent)
                self.declarations(j + 1, self.closed.get(j, end), (node, parent[1], parent[2], "::".join(x for x in (parent[3], name) if x) or None))
                self.close(node, self.closed.get(j, end))
                i = self.after(j)
            elif v == "extern" and i + 1 < end and self.kind[i + 1] == "string" and self.is_(i + 2, "{"):
                self.declarations(i + 3, self.closed.get(i + 2, end), parent)
                i = self.after(i + 2)
            elif v in ("inline", "static", "constexpr", "const") and self.word(i + 1) and (self.value[i + 1] == "namespace" or (self.value[i + 1] in _RECORDS and self.is_(i + 3, "{"))):
                i += 1
            elif v == "template" and self.is_(i + 1, "<"):
                i = self.angles(i + 1) or i + 2
            elif v in ("public", "private", "protected") and self.is_(i + 1, ":"):
                i += 2
            elif v == "using" or v == "friend":
                while i < end and not self.is_(i, ";"):
                    i = self.after(i) if self.is_(i, "{") else i + 1
                i += 1
            elif v == "typedef":
                i = self.named_type(i, end, parent)
            elif v in _RECORDS:
                i = self.record(i, end, parent)
            else:
                i = self.declarator(i, end, parent)

    def named_type(self, i: int, end: int, parent: tuple) -> int:
        at, name = i, None
        i += 1
        if self.word(i) and self.value[i] in _RECORDS:
            j = i + 1 + self.word(i + 1)
            if self.is_(j, "{"):
                i = self.record(i, end, parent, True)
        while i < end and not self.is_(i, ";"):
            if self.is_(i, "(") and self.is_(i + 1, "*") and self.word(i + 2):
                name, i = self.value[i + 2], self.after(i)
                while i < end and not self.is_(i, ";"):
                    i += 1
                break
            if self.is_(i, "<"):
                i = self.angles(i) or i + 1
                continue
            if self.is_(i, "[") or self.is_(i, "("):
                i = self.after(i)
                continue
            name = self.value[i] if self.word(i) else name
            i += 1
        if name:
            self.add("class", name, at, parent, how="typedef", doc=self.doc(at))
        return i + 1

    def record(self, i: int, end: int, parent: tuple, nested: bool = False) -> int:
        """A class, struct, union or enum, if a body follows; else the declaration that it begins."""
        kind, j = self.value[i], i + 1
        j += self.is_(j, "class") or self.is_(j, "struct")
        while self.is_(j, "[") or (self.word(j) and self.value[j] in ("alignas", "__attribute__", "__declspec")):
            j = self.after(j) if self.is_(j, "[") else self.after(j + 1)
        name = None
        while self.word(j) and (self.word(j + 1) and self.value[j + 1] not in ("final",)):
            j += 1  # export macros before the name
        if self.word(j):
            name, j = self.value[j], j + 1
            while self.is_(j, "::") and self.word(j + 1):
                name, j = self.value[j + 1], j + 2
            if self.is_(j, "<"):
                j = self.angles(j) or j
        j += self.is_(j, "final")
        base = None
        if self.is_(j, ":"):
            words = []
            while j < end and not self.is_(j, "{") and not self.is_(j, ";"):
                if self.is_(j, "<"):
                    j = self.angles(j) or j + 1
                    continue
                words += [self.value[j]] if self.word(j) and self.value[j] not in ("public", "private", "protected", "virtual") else []
                j += 1
            base = words[0] if words else None
        if not self.is_(j, "{"):
            return self.declarator(j if j > i and name and not nested else i + 1, end, parent)
        node = self.add("class", name, i, parent, how=kind, doc=self.doc(i), source=base)
        if kind != "enum":
            self.declarations(j + 1, self.closed.get(j, end), (node, None, name, parent[3]))
        self.close(node, self.closed.get(j, end))
        if name is None:
            self.rows[node]["kind"] = "block"
        i = self.after(j)
        if nested:
            return i
        while i < end and not self.is_(i, ";"):  # declared objects
            if not (self.word(i) or self.is_(i, "*") or self.is_(i, ",") or self.is_(i, "[") or self.is_(i, "=")):
                return i
            i = self.after(i) if self.is_(i, "[") else i + 1
        return i + 1

    def declarator(self, i: int, end: int, parent: tuple) -> int:
        """A function with its body, a prototype, or an object."""
        first = i
        while i < end:
            v = self.value[i]
            if self.kind[i] == "word" and v == "operator":
                j = i + 1
                while j < end and not (self.is_(j, "(") and not (j == i + 1 and self.is_(j + 1, ")"))):
                    j += 1 + (j == i + 1 and self.is_(j, "("))
                return self.callable(i, "operator" + "".join(self.value[i + 1 : j]), first, j, end, parent)
            if self.kind[i] == "op":
                if v == "(":
                    if self.word(i - 1) and i > first:
                        name = ("~" if self.is_(i - 2, "~") else "") + self.value[i - 1]
                        return self.callable(i - 1 - (name[0] == "~"), name, first, i, end, parent)
                    i = self.after(i)
                    continue
                if v == "<":
                    after = self.angles(i)
                    if after is not None and (self.is_(after, "(") and self.word(i - 1)):
                        return self.callable(i - 1, self.value[i - 1], first, after, end, parent)
                    i = after or i + 1
                    continue
                if v == ";" or v == "}":
                    return i + 1
                if v == "=":
                    return self.to_end(i, end, parent)
                if v in "[{":
                    i = self.after(i)
                    continue
            elif self.kind[i] == "pre":
                return i
            i += 1
        return end

    def to_end(self, i: int, end: int, parent: tuple) -> int:
        at = i
        while i < end and not self.is_(i, ";"):
            i = self.after(i) if self.kind[i] == "op" and self.value[i] in "([{" else i + 1
        self.body(at, min(i, end), parent)
        return i + 1

    def callable(self, name_at: int, name: str, first: int, open_: int, end: int, parent: tuple) -> int:
        qualifiers: list[str] = []
        k = name_at
        while k - 2 >= first and self.is_(k - 1, "::"):
            if self.is_(k - 2, ">"):
                k -= 2
                while k > first and not self.is_(k, "<"):
                    k -= 1
                k += 1
            if not self.word(k - 2):
                break
            qualifiers.insert(0, self.value[k - 2])
            k -= 2
        i = self.after(open_)
        while i < end:
            if self.word(i) and self.value[i] in _AFTER_PARAMETERS:
                i = self.after(i + 1) if self.is_(i + 1, "(") else i + 1
            elif self.is_(i, "&") or self.is_(i, "&&"):
                i += 1
            elif self.is_(i, "->"):
                i += 1
                while i < end and not self.is_(i, "{") and not self.is_(i, ";"):
                    i = (self.angles(i) or i + 1) if self.is_(i, "<") else self.after(i) if self.is_(i, "(") else i + 1
            elif self.is_(i, "["):
                i = self.after(i)
            else:
                break
        initial: list[int] = []
        if self.is_(i, ":"):
            i += 1
            while i < end:
                while i < end and (self.word(i) or self.is_(i, "::")):
                    i += 1
                i = (self.angles(i) or i + 1) if self.is_(i, "<") else i
                if not (self.is_(i, "(") or self.is_(i, "{")):
                    break
                initial.append(i)
                i = self.after(i)
                i += self.is_(i, ".") and 3
                if not self.is_(i, ","):
                    break
                i += 1
        owner = qualifiers[-1] if qualifiers else parent[2]
        if self.is_(i, "{"):
            at = first
            node = self.add("method" if owner else "function", name, at, (parent[0], parent[1], owner, parent[3]), doc=self.doc(at))
            inside = (node, node, owner, parent[3])
            for k in initial:
                self.body(k + 1, self.closed.get(k, end), inside)
            self.body(i + 1, self.closed.get(i, end), inside)
            self.close(node, self.closed.get(i, end))
            return self.after(i)
        if self.is_(i, ";") or self.is_(i, "="):
            self.add("prototype", name, first, (parent[0], parent[1], owner, parent[3]))
            return self.to_end(i, end, parent) if self.is_(i, "=") else i + 1
        if self.is_(i, ","):
            return self.to_end(i, end, parent)
        return max(i, self.after(open_))

    def body(self, i: int, end: int, parent: tuple) -> None:
        while i < end:
            if self.kind[i] == "pre":
                self.include(i, parent)
            elif self.kind[i] == "op":
                self.decision(i, parent)
            elif self.kind[i] == "word":
                if self.value[i] in _RECORDS and (self.is_(i + 2, "{") or self.is_(i + 2, ":")) and self.word(i + 1):
                    i = self.record(i, end, parent)
                    continue
                self.decision(i, parent)
                open_ = i + 1
                if self.is_(open_, "<"):
                    after = self.angles(open_)
                    open_ = after if after is not None and self.is_(after, "(") else open_
                if self.is_(open_, "(") and self.value[i] not in _NATIVE_WORDS and not self.typed(i):
                    receiver, joint = self.receiver(i, (".", "->", "::"))
                    name = ("~" if self.is_(i - 1, "~") and self.is_(i - 2, ".") else "") + self.value[i]
                    self.add("call", name, i, parent, receiver=receiver, how="static" if joint == "::" else "method" if joint else "direct")
                    i = open_
                    continue
            i += 1

    def typed(self, i: int) -> bool:
        """Whether the name at i follows a type, as that of a declared object does, or `new`."""
        if self.word(i - 1):
            return self.value[i - 1] not in _NATIVE_WORDS or self.value[i - 1] == "new"
        return False


def script_nodes(path: str, text: str) -> Iterator[dict]:
    """Nodes of JavaScript or TypeScript."""
    yield from _Script(path, text).rows


def native_nodes(path: str, text: str) -> Iterator[dict]:
    """Nodes of C or C++."""
    yield from _Native(path, text).rows
