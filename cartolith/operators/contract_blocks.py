"""Contract blocks in sources: found, read, written, updated, taken out and previewed by one strategy a language.

A block stands between two marks in a comment or docstring and holds keys, nested lists and maps by indentation:

    thread_safety: safe
    preconditions:
      - n must be positive
    evidence:
      - test: tests/test_n.py::test_n
        policy: required

A block that can't be read gives a contract of confidence 0. Without a block, what the language's documentation says about
the symbol counts (level 2); strategies for further languages are registered under their suffixes.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import history

BEGIN, END = "@contract-begin", "@contract-end"
#: Levels of thread safety, kinds of evidence and their policies.
THREADS = ("not_safe", "safe", "safe_after_start", "immutable", "unknown")
EVIDENCE, POLICIES = ("test", "lint", "typecheck"), ("required", "optional", "warning")
LISTS = ("invariants", "preconditions", "postconditions", "errors", "dependencies")
#: Fixed value: lines above a declaration that may hold its block.
ABOVE = 30


def _scalar(text: str) -> Any:
    """A plain or quoted value, an inline list or an inline map."""
    value, rest = _flow(text.strip())
    if rest.strip() and not rest.strip().startswith("#"):
        raise ValueError(f"more after a value: {rest}")
    return value


def _flow(text: str, stops: str = "") -> tuple[Any, str]:
    if text[:1] in ("'", '"'):
        m = re.match(r"'((?:[^']|'')*)'|\"((?:\\.|[^\"\\])*)\"", text)
        if not m:
            raise ValueError(f"a quote that is not closed: {text}")
        value = m[1].replace("''", "'") if m[1] is not None else re.sub(r"\\(.)", lambda e: {"n": "\n", "t": "\t"}.get(e[1], e[1]), m[2])
        return value, text[m.end() :]
    if text[:1] == "[":
        out, rest = [], text[1:].lstrip()
        while rest[:1] != "]":
            value, rest = _flow(rest, ",]")
            out.append(value)
            rest = rest.lstrip()
            if rest[:1] not in (",", "]"):
                raise ValueError(f"a list that is not closed: {text}")
            rest = rest[1:].lstrip() if rest[:1] == "," else rest
        return out, rest[1:]
    if text[:1] == "{":
        found, rest = {}, text[1:].lstrip()
        while rest[:1] != "}":
            m = re.match(r"([\w.-]+)\s*:\s*", rest)
            if not m:
                raise ValueError(f"a map that is not closed: {text}")
            value, rest = _flow(rest[m.end() :], ",}")
            found[m[1]], rest = value, rest.lstrip()
            if rest[:1] not in (",", "}"):
                raise ValueError(f"a map that is not closed: {text}")
            rest = rest[1:].lstrip() if rest[:1] == "," else rest
        return found, rest[1:]
    m = re.match(rf"[^{re.escape(stops)}]*" if stops else r".*?(?=\s#|$)", text)
    plain = m[0].strip()
    if plain[:1] in ("]", "}", "@", "`", "%", "&", "*", "!", "|", ">"):
        raise ValueError(f"no plain value: {plain}")
    if not stops and re.search(r":\s", plain):
        raise ValueError(f"a map within a value: {plain}")
    named = {"null": None, "~": None, "": None, "true": True, "false": False}
    value: Any = named[plain.lower()] if plain.lower() in named else int(plain) if re.fullmatch(r"[-+]?\d+", plain) else float(plain) if re.fullmatch(r"[-+]?\d+\.\d*", plain) else plain
    return value, text[m.end() :]


_KEY = re.compile(r"([\w.][\w .-]*?|'[^']*'|\"[^\"]*\")\s*:(?:\s+(.*)|)$")


def read_block(text: str) -> Any:
    """What a block's lines hold; ValueError if they are not well formed."""
    rows = [(len(line) - len(line.lstrip(" ")), line.strip()) for line in text.splitlines() if line.strip() and not line.strip().startswith("#")]
    if any(line.startswith("\t") or "\t" in raw[: len(raw) - len(raw.lstrip())] for raw in text.splitlines() for line in (raw,)):
        raise ValueError("a tab in the indentation")
    value, at = _node(rows, 0, rows[0][0]) if rows else (None, 0)
    if at < len(rows):
        raise ValueError(f"a line out of place: {rows[at][1]}")
    return value


def _node(rows: list[tuple[int, str]], at: int, indent: int) -> tuple[Any, int]:
    if rows[at][1] == "-" or rows[at][1].startswith("- "):
        out = []
        while at < len(rows) and rows[at][0] == indent and (rows[at][1] == "-" or rows[at][1].startswith("- ")):
            rest = rows[at][1][1:]
            inner = indent + 1 + len(rest) - len(rest.lstrip())
            if not rest.strip():
                at += 1
                value, at = _node(rows, at, rows[at][0]) if at < len(rows) and rows[at][0] > indent else (None, at)
            elif _KEY.match(rest.strip()) or rest.strip().startswith("- "):
                rows[at] = (inner, rest.strip())  # a map or list that begins beside the dash
                value, at = _node(rows, at, inner)
            else:
                value, at = _scalar(rest), at + 1
            out.append(value)
        return out, at
    found: dict[str, Any] = {}
    while at < len(rows) and rows[at][0] == indent:
        m = _KEY.match(rows[at][1])
        if not m:
            if not found:
                return _scalar(rows[at][1]), at + 1
            raise ValueError(f"no key: {rows[at][1]}")
        key, at = m[1].strip("'\""), at + 1
        if m[2] is not None and m[2].strip() and not m[2].strip().startswith("#"):
            found[key] = _scalar(m[2])
        elif at < len(rows) and (rows[at][0] > indent or (rows[at][0] == indent and rows[at][1].startswith("- "))):
            found[key], at = _node(rows, at, rows[at][0])
        else:
            found[key] = None
    if at < len(rows) and rows[at][0] > indent:
        raise ValueError(f"a line too deep: {rows[at][1]}")
    return found, at


def _strings(value: Any) -> list[str]:
    parts = value if isinstance(value, list) else [] if value is None else [value]
    return [", ".join(f"{k}: {v}" for k, v in p.items()) if isinstance(p, dict) else str(p) for p in parts]


def contract_of(text: str) -> dict[str, Any]:
    """The fields of a block; of confidence 0, with a note, if it can't be read or holds no keys."""
    empty: dict[str, Any] = {"thread_safety": "unknown", "lifecycle": None, **{k: [] for k in LISTS}, "evidence": []}
    try:
        data = read_block(text)
    except ValueError as e:
        return empty | {"level": 1, "confidence": 0.0, "note": f"invalid: {e}"}
    if not isinstance(data, dict) or not data:
        return empty | {"level": 1, "confidence": 0.0, "note": "empty or no map"}
    evidence = []
    for item in data.get("evidence") or []:
        kind = next((k for k in EVIDENCE if isinstance(item, dict) and item.get(k) is not None), None)
        policy = item.get("policy", "optional") if kind else None
        if kind and policy in POLICIES:
            evidence.append({"type": kind, "reference": str(item[kind]), "policy": policy})
    threads = data.get("thread_safety", "unknown")
    lifecycle = data.get("lifecycle")
    read = {"thread_safety": threads if threads in THREADS else "unknown", "lifecycle": None if lifecycle is None else str(lifecycle), "evidence": evidence}
    return empty | read | {k: _strings(data.get(k)) for k in LISTS} | {"level": 1, "confidence": 1.0, "note": None}


def _quoted(text: str) -> str:
    """A value as it can be read again."""
    try:
        plain = isinstance(_scalar(text), str) and _scalar(text) == text and not _KEY.match(text) and not text.startswith(("- ", "#")) and text != "-" and " #" not in text
    except ValueError:
        plain = False
    return text if plain else "'" + text.replace("'", "''") + "'"


def block_lines(contract: dict[str, Any]) -> list[str]:
    """The lines of a block that gives the contract when read; what is empty is left out."""
    out = [f"thread_safety: {contract.get('thread_safety') or 'unknown'}"]
    if contract.get("lifecycle"):
        out.append(f"lifecycle: {_quoted(contract['lifecycle'])}")
    for key in LISTS:
        if contract.get(key):
            out += [f"{key}:", *(f"  - {_quoted(x)}" for x in contract[key])]
    if contract.get("evidence"):
        out.append("evidence:")
        for e in contract["evidence"]:
            out.append(f"  - {e['type']}: {_quoted(e['reference'])}")
            if e.get("policy", "optional") != "optional":
                out.append(f"    policy: {e['policy']}")
    return out


class Strategy:
    """How a language holds contracts. Lines are counted from 1; a block is (first line, last line) with its marks."""

    prefix = ""

    def find(self, lines: list[str], symbol: int) -> tuple[int, int] | None:
        raise NotImplementedError

    def comment(self, lines: list[str], symbol: int) -> str | None:
        raise NotImplementedError

    def documented(self, comment: str) -> dict[str, Any]:
        raise NotImplementedError

    def insert(self, lines: list[str], symbol: int, block: list[str]) -> list[str]:
        raise NotImplementedError

    def content(self, lines: list[str], block: tuple[int, int]) -> str:
        """The block's lines without what makes them comments, their own indentation kept."""
        bare = [re.sub(r"^(\s*)(?://|\*(?!/)|#)", r"\1", line) if self.prefix else line for line in lines[block[0] : block[1] - 1]]
        margin = min((len(x) - len(x.lstrip()) for x in bare if x.strip()), default=0)
        return "\n".join(x[margin:] for x in bare)

    def marked(self, indent: str, contract: dict[str, Any]) -> list[str]:
        return [f"{indent}{self.prefix}{line}".rstrip() for line in (BEGIN, *block_lines(contract), END)]

    def written(self, text: str, symbol: int, contract: dict[str, Any]) -> str:
        """The text with the contract in place of the symbol's block, or in a new one; all other lines stay."""
        lines = text.split("\n")
        block = self.find(lines, symbol)
        if block is None:
            return "\n".join(self.insert(lines, symbol, self.marked("", contract)))
        first = lines[block[0] - 1]
        return "\n".join(lines[: block[0] - 1] + self.marked(first[: len(first) - len(first.lstrip())], contract) + lines[block[1] :])

    def removed(self, text: str, symbol: int) -> str:
        lines = text.split("\n")
        block = self.find(lines, symbol)
        return text if block is None else "\n".join(lines[: block[0] - 1] + lines[block[1] :])

    def read(self, text: str, symbol: int) -> dict[str, Any]:
        """The symbol's contract: from its block, else its documentation (level 2), else none (level 5)."""
        lines = text.split("\n")
        block = self.find(lines, symbol)
        if block is not None:
            return contract_of(self.content(lines, block))
        comment = self.comment(lines, symbol)
        found = self.documented(comment) if comment else {}
        said = any(v for k, v in found.items() if k != "thread_safety") or found.get("thread_safety", "unknown") != "unknown"
        base: dict[str, Any] = {"thread_safety": "unknown", "lifecycle": None, **{k: [] for k in LISTS}, "evidence": [], "note": None}
        return base | found | ({"level": 2, "confidence": 0.8} if said else {"level": 5, "confidence": 0.0})


def _threads(text: str) -> str:
    for pattern, value in ((r"not\s+thread[_-]?safe", "not_safe"), (r"safe\s+after\s+start", "safe_after_start"), (r"thread[_-]?safe", "safe"), (r"immutable", "immutable")):
        if re.search(pattern, text, re.I):
            return value
    return "unknown"


class TaggedComments(Strategy):
    """Comments before the declaration with tags: C, C++, JavaScript and TypeScript."""

    prefix = "// "

    def find(self, lines: list[str], symbol: int) -> tuple[int, int] | None:
        last = None
        for i in range(min(symbol - 1, len(lines)), max(0, symbol - 1 - ABOVE), -1):
            if last is None and END in lines[i - 1]:
                last = i
            elif BEGIN in lines[i - 1]:
                return (i, last) if last is not None else None
        return None

    def comment(self, lines: list[str], symbol: int) -> str | None:
        i = symbol - 1
        while i > 0 and not lines[i - 1].strip():
            i -= 1
        if i <= 0:
            return None
        found: list[str] = []
        if lines[i - 1].strip().endswith("*/"):
            while i > 0:
                found.insert(0, lines[i - 1])
                if "/*" in lines[i - 1]:
                    break
                i -= 1
        else:
            while i > 0 and (lines[i - 1].strip().startswith("//") or not lines[i - 1].strip()):
                found.insert(0, lines[i - 1])
                i -= 1
        bare = [re.sub(r"^\s*(?:/\*+|\*+/|\*|///?)\s?|\s*\*+/\s*$", "", x).strip() for x in found]
        return "\n".join(bare) if any(bare) else None

    def documented(self, comment: str) -> dict[str, Any]:
        tag = lambda names: [" ".join(m.split()) for m in re.findall(rf"(?s)[@\\](?:{names})\s+(.+?)(?=\n\s*[@\\]|\Z)", comment)]
        errors = [re.sub(r"^\{?([\w:.]+)\}?\s+", r"\1: ", x) for x in tag("throws?|exception") if len(x.split()) > 1]
        return {"preconditions": tag("pre"), "postconditions": tag("post|returns?"), "invariants": tag("invariant"), "errors": errors, "thread_safety": _threads(comment)}

    def insert(self, lines: list[str], symbol: int, block: list[str]) -> list[str]:
        at = lines[symbol - 1] if symbol <= len(lines) else ""
        indent = at[: len(at) - len(at.lstrip())]
        return lines[: symbol - 1] + [indent + x for x in block] + lines[symbol - 1 :]


class Docstrings(Strategy):
    """Docstrings after the definition, in sections: Python."""

    def _body(self, lines: list[str], symbol: int) -> int:
        """The line after the definition's head."""
        i = symbol
        while i < len(lines) and not re.search(r":\s*(#.*)?$", lines[i - 1]):
            i += 1
        return i + 1

    def _docstring(self, lines: list[str], symbol: int) -> tuple[int, int, str] | None:
        """First and last line and the quotes of the string that the body begins with."""
        i = self._body(lines, symbol)
        while i <= len(lines) and not lines[i - 1].strip():
            i += 1
        m = re.match(r"\s*[rRuU]?(\"\"\"|''')", lines[i - 1]) if i <= len(lines) else None
        if m is None:
            return None
        if m[1] in lines[i - 1][m.end() :]:
            return i, i, m[1]
        end = next((j for j in range(i + 1, len(lines) + 1) if m[1] in lines[j - 1]), None)
        return None if end is None else (i, end, m[1])

    def find(self, lines: list[str], symbol: int) -> tuple[int, int] | None:
        found = self._docstring(lines, symbol)
        if found is None:
            return None
        first = next((i for i in range(found[0], found[1] + 1) if BEGIN in lines[i - 1]), None)
        last = next((i for i in range(found[0], found[1] + 1) if END in lines[i - 1]), None)
        return (first, last) if first is not None and last is not None and first < last else None

    def comment(self, lines: list[str], symbol: int) -> str | None:
        found = self._docstring(lines, symbol)
        if found is None:
            return None
        text = "\n".join(lines[found[0] - 1 : found[1]])
        return text.split(found[2])[1] or None

    def documented(self, comment: str) -> dict[str, Any]:
        sections: dict[str, list[str]] = {}
        current: list[str] = []
        for line in comment.splitlines():
            head = re.match(r"\s*(Args|Arguments|Returns|Yields|Raises|Attributes|Notes?|Examples?):", line)
            if head:
                current = sections.setdefault(head[1], [])
            else:
                current.append(line.strip())
        joined = lambda *names: " ".join(x for n in names for x in sections.get(n, []) if x)
        args, notes, returns = joined("Args", "Arguments"), joined("Note", "Notes"), joined("Returns")
        pre = ["input is not None"] if "must not be none" in args.lower() else []
        must = re.search(r"must be ([^.]+)", args, re.I)
        threads = "unknown"
        if re.search(r"thread-?safe", notes, re.I):
            threads = "not_safe" if re.search(r"not thread", notes, re.I) else "safe_after_start" if re.search("after start", notes, re.I) else "safe"
        return {"preconditions": pre + ([f"input must be {must[1].strip()}"] if must else []), "postconditions": [f"returns: {returns}"] if returns else [], "errors": [x for x in sections.get("Raises", []) if x], "thread_safety": threads}

    def insert(self, lines: list[str], symbol: int, block: list[str]) -> list[str]:
        found = self._docstring(lines, symbol)
        own = lines[symbol - 1]
        inner = own[: len(own) - len(own.lstrip())] + "    "
        told = [inner + x for x in block]
        if found is None:
            end = self._body(lines, symbol) - 1
            return [*lines[:end], f'{inner}"""', *told, f'{inner}"""', *lines[end:]]
        first, last, quote = found
        head, rest = lines[first - 1].split(quote, 1)
        if first == last:
            said = rest.rsplit(quote, 1)
            return [*lines[: first - 1], f"{head}{quote}", *told, "", f"{inner}{said[0].strip()}", f"{head}{quote}{said[1]}", *lines[first:]]
        text = [f"{inner}{rest.strip()}"] if rest.strip() else []
        return [*lines[: first - 1], f"{head}{quote}", *told, "", *text, *lines[first:]]


STRATEGIES: dict[str, Strategy] = {s: TaggedComments() for s in ("c", "h", "cc", "hh", "cpp", "hpp", "cxx", "hxx", "js", "jsx", "mjs", "cjs", "ts", "tsx")} | {s: Docstrings() for s in ("py", "pyi", "pyw")}


def strategy_of(path: str, own: dict[str, Strategy] | None = None) -> Strategy | None:
    """The strategy of a file's suffix; `own` adds or replaces some."""
    return (STRATEGIES | (own or {})).get(path.rpartition(".")[2].lower())


_EVIDENCE = pa.list_(pa.struct([("type", pa.string()), ("reference", pa.string()), ("policy", pa.string())]))
CONTRACT = "level int, confidence double, note string, thread_safety string, lifecycle string, " + ", ".join(f"{k} array<string>" for k in LISTS) + ", evidence array<struct<type:string,reference:string,policy:string>>"
_ARROW = [("level", pa.int32()), ("confidence", pa.float64()), ("note", pa.string()), ("thread_safety", pa.string()), ("lifecycle", pa.string()), *((k, pa.list_(pa.string())) for k in LISTS), ("evidence", _EVIDENCE)]


def _made(df: DataFrame, columns: list[str], schema: str, arrow: list[tuple[str, pa.DataType]], make: Callable[..., dict[str, Any]]) -> DataFrame:
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [make(*row) for row in zip(*(batch.column(c).to_pylist() for c in columns), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([r[name] for r in found], kind) for name, kind in arrow)], names=[*batch.schema.names, *(name for name, _ in arrow)])

    return df.mapInArrow(run, f"{kinds}, {schema}")


def read(symbols: DataFrame, path: str = "path", text: str = "text", line: str = "line", own: dict[str, Strategy] | None = None) -> DataFrame:
    """symbols with their contracts (CONTRACT); files of no known language have none (level 5)."""

    def make(p: str, source: str, at: int) -> dict[str, Any]:
        strategy = strategy_of(p, own)
        nothing = {"level": 5, "confidence": 0.0, "note": None, "thread_safety": "unknown", "lifecycle": None, **{k: [] for k in LISTS}, "evidence": []}
        return nothing if strategy is None else nothing | strategy.read(source or "", at)

    return _made(symbols, [path, text, line], CONTRACT, _ARROW, make)


def rewrite(symbols: DataFrame, contract: str | None, path: str = "path", text: str = "text", line: str = "line", own: dict[str, Strategy] | None = None) -> DataFrame:
    """symbols with `rewritten`: the text with the column `contract` (fields as of CONTRACT) as the symbol's block, or without its block."""

    def make(p: str, source: str, at: int, *fields: Any) -> dict[str, Any]:
        strategy = strategy_of(p, own)
        if strategy is None:
            return {"rewritten": source}
        return {"rewritten": strategy.written(source or "", at, fields[0] or {}) if fields else strategy.removed(source or "", at)}

    return _made(symbols, [path, text, line] + ([contract] if contract else []), "rewritten string", [("rewritten", pa.string())], make)


def preview(rewritten: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """The hunks between each symbol's text and what it would become."""
    return history.hunks(rewritten.select(*key, F.col(text).alias("before"), F.col("rewritten").alias("after")), key, "before", "after")
