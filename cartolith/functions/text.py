"""Text, path, number and status functions as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Language of a file name's extension.
LANGUAGES = {"py": "python", "pyw": "python", "pyi": "python", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript", "tsx": "typescript", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "hh": "cpp", "hxx": "cpp", "c": "c", "h": "c"}
#: Directories that scans leave out, and prefixes of such.
EXCLUDED_DIRS = ("node_modules", "__pycache__", "build", "dist", "venv", "env", "out", "target", "test", "tests", "_deps", "vendor")
EXCLUDED_PREFIXES = (".", "cmake-build-", "CMakeFiles")
#: Extensions that scans keep.
SOURCE_SUFFIXES = (".py", ".js", ".jsx", ".ts", ".tsx", ".c", ".h", ".cpp", ".hpp", ".cc", ".hh", ".html", ".htm")


def truncate(text: Column, limit: int) -> Column:
    """At most `limit` characters, the last three of a cut text being dots."""
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit - 3), F.lit("..."))).otherwise(text)


def glob_to_regex(pattern: str) -> str:
    """A case-insensitive, unanchored regular expression: ** crosses directories, * and ? do not."""
    out, i = "", 0
    while i < len(pattern):
        if pattern.startswith("**", i):
            out, i = out + ".*", i + 2
            i += pattern.startswith("/", i)
            continue
        c = pattern[i]
        out += {"*": "[^/]*", "?": "[^/]"}.get(c) or re.escape(c)
        i += 1
    return "(?i)" + out


def suffix(path: Column) -> Column:
    """Lower-cased extension with its dot; empty if the name has none."""
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def language_of(extension: Column) -> Column:
    """Language of an extension with or without its dot; 'unknown' for others."""
    bare = F.regexp_replace(F.lower(extension), r"^\.", "")
    out = F.lit("unknown")
    for language in sorted(set(LANGUAGES.values())):
        out = F.when(bare.isin([k for k, v in LANGUAGES.items() if v == language]), language).otherwise(out)
    return out


def excluded(path: Column, extra: tuple[str, ...] = ()) -> Column:
    """Whether a directory of the path is left out of scans."""
    names = [*EXCLUDED_DIRS, *extra]
    return F.exists(F.split(path, "/"), lambda x: x.isin(names) | _any([x.startswith(p) for p in EXCLUDED_PREFIXES]))


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def parent_path(path: Column) -> Column:
    return F.when(F.instr(path, "/") == 0, F.lit("")).otherwise(F.regexp_replace(path, r"/[^/]*$", ""))


def module_name(path: Column) -> Column:
    """A path without its suffix, dots for slashes."""
    return F.replace(F.regexp_replace(path, r"\.[^./]+$", ""), F.lit("/"), F.lit("."))


def resolve_relative(module: Column, relative: Column, level: Column) -> Column:
    """The module that `from ..relative import x` names inside `module`: `level` names are dropped from its end."""
    parts = F.split(module, r"\.")
    kept = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - level, F.lit(0)))
    return F.concat_ws(".", F.array_compact(F.concat(kept, F.array(F.nullif(relative, F.lit(""))))))


def symbol_id(path: Column, line: Column, col: Column, kind: Column, name: Column) -> Column:
    return F.concat_ws(":", path, line.cast("string"), col.cast("string"), kind, name)


def parsed_symbol_id(value: Column) -> Column:
    """Struct of path, line, col, kind and name; the path may hold colons."""
    pattern = r"^(.*):(\d+):(\d+):([^:]*):([^:]*)$"
    return F.struct(*(F.regexp_extract(value, pattern, i).cast(t).alias(n) for i, n, t in ((1, "path", "string"), (2, "line", "int"), (3, "col", "int"), (4, "kind", "string"), (5, "name", "string"))))


def format_duration(ms: Column) -> Column:
    """550ms, 12.3s, 4m 5s, 2h 3m."""
    seconds = F.floor(ms / 1000)
    return (
        F.when(ms < 1000, F.concat(ms.cast("long").cast("string"), F.lit("ms")))
        .when(ms < 60_000, F.concat(F.format_string("%.1f", ms / 1000.0), F.lit("s")))
        .when(ms < 3_600_000, F.concat(F.floor(seconds / 60).cast("string"), F.lit("m "), (seconds % 60).cast("string"), F.lit("s")))
        .otherwise(F.concat(F.floor(seconds / 3600).cast("string"), F.lit("h "), F.floor(seconds % 3600 / 60).cast("string"), F.lit("m")))
    )


def format_bytes(n: Column) -> Column:
    """Sizes in powers of 1024 with one decimal; null for null or negative."""
    out = F.format_string("%.1f TB", n / float(1 << 40))
    for unit, power in (("GB", 30), ("MB", 20), ("KB", 10)):
        out = F.when(n < float(1 << (power + 10)), F.format_string(f"%.1f {unit}", n / float(1 << power))).otherwise(out)
    return F.when(n < 0, F.lit(None)).when(n < 1024, F.concat(n.cast("long").cast("string"), F.lit(" B"))).otherwise(out)


def parse_flag(raw: Column) -> Column:
    """Whether an environment value switches something on."""
    return F.coalesce(F.lower(F.trim(raw)).isin("1", "true", "yes", "on"), F.lit(False))


def parse_limit(raw: Column) -> Column:
    """A whole number not below zero, else null."""
    n = F.trim(raw).try_cast("long")
    return F.when(n >= 0, n)


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, 0 where whole is 0."""
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def percent_text(part: Column, whole: Column) -> Column:
    return F.format_string("%.1f%%", ratio(part, whole) * 100)


def line_count(text: Column) -> Column:
    """Lines as splitlines counts them: a final newline ends the last line, an empty text has none."""
    n = F.size(F.split(text, "\n"))
    return F.when(text == "", 0).when(text.endswith("\n"), n - 1).otherwise(n)


def strip_ansi(text: Column) -> Column:
    """Without terminal escape sequences."""
    return F.regexp_replace(text, r"\x1B(?:[@-Z\\-_]|\[[0-?]*[ -/]*[@-~])", "")


def status_label(code: Column) -> Column:
    """Label of a two-letter working-tree status; of several letters the first of U, D, R, C, A, M counts."""
    out = F.lit("modified")
    for letter, label in reversed([("U", "conflict"), ("D", "deleted"), ("R", "renamed"), ("C", "copied"), ("A", "added"), ("M", "modified")]):
        out = F.when(F.contains(code, F.lit(letter)), label).otherwise(out)
    return F.when(code == "??", "untracked").when(code == "!!", "ignored").otherwise(out)


def coerce_to(value: Column, allowed: tuple[str, ...], default: str) -> Column:
    """The lower-cased value if it is allowed, else the default."""
    v = F.lower(F.trim(value))
    return F.when(v.isin(list(allowed)), v).otherwise(F.lit(default))


def base_type(hint: Column) -> Column:
    """Optional[X] and unions give X or their first member, containers their own name."""
    inner = F.regexp_extract(hint, r"^(?:typing\.)?Optional\[(.*)\]$", 1)
    inner = F.when(inner != "", inner).otherwise(hint)
    union = F.regexp_extract(inner, r"^(?:typing\.)?Union\[([^,\]]+)", 1)
    inner = F.when(union != "", union).otherwise(inner)
    inner = F.trim(F.element_at(F.split(inner, r"\|"), 1))
    return F.regexp_replace(F.regexp_replace(inner, r"\[.*$", ""), "[\"']", "")


def is_pascal_case(name: Column) -> Column:
    return name.rlike(r"^_*[A-Z][A-Za-z0-9]*$") & name.rlike("[a-z]")


def change_summary(staged: Column, unstaged: Column, rename_from: Column) -> Column:
    """What a working-tree change is, in words, with the scopes (staged, working tree) that it has."""
    has = lambda flag: (F.trim(flag) != "") & ~F.trim(flag).isin("?", "!")
    scope = (
        F.when(has(staged) & has(unstaged), "staged + working tree changes").when(has(staged), "staged changes")
        .when(has(unstaged), "working tree changes").otherwise("")
    )
    label = status_label(F.concat(staged, unstaged))
    capital = F.concat(F.upper(F.substring(label, 1, 1)), F.substring(label, 2, 100))
    return (
        F.when(label == "ignored", "Ignored file").when(label == "untracked", "New file (not committed yet)")
        .when((label == "renamed") & rename_from.isNotNull(), F.concat(F.lit("Renamed from "), rename_from))
        .when((label == "deleted") & (scope == ""), "Deleted locally").when(label == "deleted", F.concat(F.lit("Deleted "), scope))
        .when(label == "conflict", "Merge conflict in progress").when(scope != "", F.concat(capital, F.lit(" ("), scope, F.lit(")"))).otherwise(capital)
    )


def within_root(relative: Column) -> Column:
    """Whether a relative path stays in its root: no prefix of it has more .. than names; absolute paths leave it."""
    steps = F.transform(F.split(relative, "/"), lambda x: F.when(x == "..", -1).when(x.isin("", "."), 0).otherwise(1))
    walked = F.aggregate(steps, F.struct(F.lit(0).alias("at"), F.lit(0).alias("low")), lambda a, x: F.struct((a["at"] + x).alias("at"), F.least(a["low"], a["at"] + x).alias("low")))
    return ~relative.startswith("/") & (walked["low"] >= 0)


def version_of(text: Column) -> Column:
    """The first version number (digits joined by dots) of a text, null if it has none."""
    return F.nullif(F.regexp_extract(text, r"(\d+(?:\.\d+)+)", 1), F.lit(""))


def display_name(qualified: Column) -> Column:
    """The last name of a dotted one, without what it is called with."""
    return F.substring_index(F.substring_index(qualified, "(", 1), ".", -1)
