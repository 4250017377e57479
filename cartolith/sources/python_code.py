"""Row generators over Python source: symbols, imports, class references, calls, variable types and findings.

Each generator maps one file to rows with the standard library's `ast`, runs in Arrow batches, and turns a syntax error
into one row that says so, or none.
"""

from __future__ import annotations

import ast
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

_FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)
_DECISIONS = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler)
#: Methods that belong together by start and end, and whether such a pair is a strong sign.
LIFECYCLE_PAIRS = (
    ("start", "stop", True), ("run", "stop", True), ("begin", "end", False), ("open", "close", True), ("connect", "disconnect", True), ("initialize", "cleanup", True),
    ("init", "cleanup", False), ("setup", "teardown", True), ("enable", "disable", False), ("activate", "deactivate", False), ("acquire", "release", True), ("enter", "exit", False),
)
#: Constructors that point to synchronisation, strong and weaker signs.
THREAD_STRONG = (
    "threading.Lock", "threading.RLock", "threading.Condition", "threading.Semaphore", "threading.BoundedSemaphore", "Lock", "RLock",
    "asyncio.Lock", "asyncio.Semaphore", "asyncio.BoundedSemaphore", "queue.Queue", "queue.LifoQueue", "queue.PriorityQueue", "asyncio.Queue",
)
THREAD_WEAK = ("threading.Event", "threading.Barrier", "Condition", "Semaphore", "asyncio.Event", "asyncio.Condition", "Queue")


def complexity(node: ast.AST) -> int:
    """1, plus one for each branch, loop and handler, plus the operands of boolean expressions but one."""
    n = 1
    for x in ast.walk(node):
        n += isinstance(x, _DECISIONS)
        n += len(x.values) - 1 if isinstance(x, ast.BoolOp) else 0
    return n


def dotted(node: ast.AST | None) -> str | None:
    """a.b.c of a name or attribute; subscripts and calls are looked through."""
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Attribute):
        head = dotted(node.value)
        return f"{head}.{node.attr}" if head else None
    if isinstance(node, ast.Subscript):
        return dotted(node.value)
    if isinstance(node, ast.Call):
        return dotted(node.func)
    if isinstance(node, ast.Constant) and isinstance(node.value, str):
        return node.value
    return None


def symbols(path: str, text: str) -> Iterator[dict]:
    """Top-level functions, classes and their methods."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError) as e:
        yield {"path": path, "name": None, "kind": "error", "lineno": getattr(e, "lineno", None), "parent": None, "docstring": str(e), "loc": None, "complexity": None}
        return

    def row(node, kind: str, parent: str | None) -> dict:
        plain = kind != "class"
        return {
            "path": path, "name": node.name, "kind": kind, "lineno": node.lineno, "parent": parent, "docstring": ast.get_docstring(node),
            "loc": node.end_lineno - node.lineno + 1 if plain else None, "complexity": complexity(node) if plain else None,
        }

    for node in tree.body:
        if isinstance(node, _FUNCTIONS):
            yield row(node, "function", None)
        elif isinstance(node, ast.ClassDef):
            yield row(node, "class", None)
            yield from (row(x, "method", node.name) for x in node.body if isinstance(x, _FUNCTIONS))


def _tree(text: str) -> ast.Module | None:
    try:
        return ast.parse(text)
    except (SyntaxError, ValueError):
        return None


def imports(path: str, text: str) -> Iterator[dict]:
    """One row per imported name, leading dots kept as a level."""
    for node in ast.walk(_tree(text) or ast.Module([], [])):
        if isinstance(node, ast.Import):
            yield from ({"path": path, "module": a.name, "name": None, "alias": a.asname or a.name, "level": 0} for a in node.names)
        elif isinstance(node, ast.ImportFrom):
            yield from ({"path": path, "module": node.module or "", "name": a.name, "alias": a.asname or a.name, "level": node.level} for a in node.names)


def class_references(path: str, text: str) -> Iterator[dict]:
    """Bases, instantiated names and annotated names of each class, once each."""
    for cls in (x for x in ast.walk(_tree(text) or ast.Module([], [])) if isinstance(x, ast.ClassDef)):
        found: set[tuple[str, str]] = {("inherits", b) for b in map(dotted, cls.bases) if b}
        for node in ast.walk(cls):
            if isinstance(node, ast.Call) and (name := dotted(node.func)) and name.split(".")[-1][:1].isupper():
                found.add(("instantiates", name))
            hint = node.annotation if isinstance(node, (ast.AnnAssign, ast.arg)) else node.returns if isinstance(node, _FUNCTIONS) else None
            for part in ast.walk(hint) if hint is not None else ():
                if (name := dotted(part)) and isinstance(part, (ast.Name, ast.Attribute)) and name.split(".")[-1][:1].isupper():
                    found.add(("references", name))
        yield from ({"path": path, "owner": cls.name, "raw": raw, "type": kind} for kind, raw in sorted(found))


def calls(path: str, text: str) -> Iterator[dict]:
    """Call sites of functions and methods: what is called on what, and how."""
    tree = _tree(text) or ast.Module([], [])
    owners = [(None, x) for x in tree.body if isinstance(x, _FUNCTIONS)]
    classes = {c.name for c in tree.body if isinstance(c, ast.ClassDef)}
    owners += [(c.name, x) for c in tree.body if isinstance(c, ast.ClassDef) for x in c.body if isinstance(x, _FUNCTIONS)]
    for owner, function in owners:
        caller = f"{owner}.{function.name}" if owner else function.name
        for node in ast.walk(function):
            if not isinstance(node, ast.Call):
                continue
            if isinstance(node.func, ast.Attribute):
                receiver, name = dotted(node.func.value), node.func.attr
                kind = "self" if receiver in ("self", "cls") else "static" if receiver in classes else "method"
            elif isinstance(node.func, ast.Name):
                receiver, name = None, node.func.id
                kind = "constructor" if name in classes or name[:1].isupper() else "direct"
            else:
                continue
            yield {"path": path, "caller": caller, "owner": owner, "callee": name, "receiver": receiver, "call_type": kind, "line": node.lineno}


def variable_types(path: str, text: str) -> Iterator[dict]:
    """Candidates for the types of local names: annotations 1.0, constructors 0.9, return types of local functions 0.8."""
    tree = _tree(text) or ast.Module([], [])
    returns = {f.name: dotted(f.returns) for f in tree.body if isinstance(f, _FUNCTIONS) and f.returns is not None}
    for function in (x for x in ast.walk(tree) if isinstance(x, _FUNCTIONS)):
        found = [(a.arg, ast.unparse(a.annotation), 1.0) for a in function.args.args if a.annotation is not None]
        for node in ast.walk(function):
            if isinstance(node, ast.AnnAssign) and isinstance(node.target, ast.Name):
                found.append((node.target.id, ast.unparse(node.annotation), 1.0))
            elif isinstance(node, ast.Assign) and isinstance(node.value, ast.Call) and isinstance(node.targets[0], ast.Name):
                name = dotted(node.value.func)
                if name and name.split(".")[-1][:1].isupper():
                    found.append((node.targets[0].id, name, 0.9))
                elif name in returns and returns[name]:
                    found.append((node.targets[0].id, returns[name], 0.8))
        yield from ({"path": path, "function": function.name, "variable": v, "type": t, "confidence": c} for v, t, c in found)


#: Names of the typing module that are no types of their own.
_TYPING = frozenset("Optional Union Any List Dict Set Tuple FrozenSet Callable Iterable Iterator Sequence Mapping Type Literal Final ClassVar None".split())


def _named_types(hint: ast.AST | None) -> Iterator[str]:
    """Class names in an annotation: PascalCase, typing's own names left out."""
    if isinstance(hint, ast.Constant) and isinstance(hint.value, str):
        try:
            hint = ast.parse(hint.value, mode="eval").body
        except SyntaxError:
            return
    if isinstance(hint, ast.Name | ast.Attribute):
        name = dotted(hint)
        if name and name.split(".")[-1] not in _TYPING and name.split(".")[-1][:1].isupper():
            yield name
    elif hint is not None:
        for child in ast.iter_child_nodes(hint):
            yield from _named_types(child)


def uml(path: str, text: str) -> Iterator[dict]:
    """Members and relations of classes: attributes, methods without self, bases, associations and instantiations."""
    for cls in (x for x in ast.walk(_tree(text) or ast.Module([], [])) if isinstance(x, ast.ClassDef)):
        row = lambda kind, name, hint=None, optional=False: {"path": path, "owner": cls.name, "kind": kind, "name": name, "type": hint, "optional": optional}  # noqa: E731,B023
        for base in map(dotted, cls.bases):
            if base:
                yield row("inheritance", base)
        targets = [(x.target.id, x.annotation, None) for x in cls.body if isinstance(x, ast.AnnAssign) and isinstance(x.target, ast.Name)]
        own = set()
        for method in (x for x in cls.body if isinstance(x, _FUNCTIONS)):
            args = [a.arg for a in method.args.args if a.arg not in ("self", "cls")]
            yield row("method", f"{method.name}({', '.join(args)})", ast.unparse(method.returns) if method.returns else None)
            for node in ast.walk(method):
                place = node.target if isinstance(node, ast.AnnAssign) else node.targets[0] if isinstance(node, ast.Assign) else None
                if isinstance(place, ast.Attribute) and isinstance(place.value, ast.Name) and place.value.id == "self":
                    targets.append((place.attr, node.annotation if isinstance(node, ast.AnnAssign) else None, node.value))
                    own.add(id(node.value))
        seen = set()
        for name, hint, value in targets:
            made = dotted(value.func) if isinstance(value, ast.Call) else None
            made = made if made and made.split(".")[-1][:1].isupper() else None
            if name not in seen:
                shown = ast.unparse(hint) if hint is not None else made
                optional = bool(shown) and ("Optional" in shown or "None" in shown)
                yield row("attribute", name, shown, optional)
                for t in dict.fromkeys([*_named_types(hint), *([made] if made else [])]):
                    yield row("association", t, name, optional)
            seen.add(name)
        calls = [dotted(x.func) for x in ast.walk(cls) if isinstance(x, ast.Call) and id(x) not in own]
        for name in dict.fromkeys(c for c in calls if c and c.split(".")[-1][:1].isupper()):
            yield row("instantiation", name)


def findings(path: str, text: str) -> Iterator[dict]:
    """Static findings of classes: lifecycle pairs, dependencies, ownership and thread safety."""
    for cls in (x for x in ast.walk(_tree(text) or ast.Module([], [])) if isinstance(x, ast.ClassDef)):
        methods = {x.name: x for x in cls.body if isinstance(x, _FUNCTIONS)}
        row = lambda kind, value, confidence, line: {"path": path, "owner": cls.name, "type": kind, "value": value, "confidence": confidence, "line": line}  # noqa: E731,B023
        for start, end, strong in LIFECYCLE_PAIRS:
            if start in methods and end in methods:
                yield row("lifecycle", f"{start} -> {end}", 0.4 if strong else 0.3, methods[start].lineno)
        init = methods.get("__init__")
        for arg in init.args.args[1:] if init else ():
            if arg.annotation is not None and (name := dotted(arg.annotation)) and name.split(".")[-1][:1].isupper():
                yield row("dependency", f"requires {name}", 0.4, init.lineno)
        for name, method in methods.items():
            if name.startswith("set_") and len(method.args.args) == 2 and (hint := dotted(method.args.args[1].annotation)):
                yield row("dependency", f"optional {hint}", 0.3, method.lineno)
        for base in map(dotted, cls.bases):
            last = (base or "").split(".")[-1]
            if last.startswith(("Abstract", "Base")) or (last[:1] == "I" and last[1:2].isupper()):
                yield row("dependency", f"implements {last}", 0.3, cls.lineno)
        for node in ast.walk(init) if init else ():
            if isinstance(node, ast.Assign) and isinstance(node.value, ast.Call) and isinstance(node.targets[0], ast.Attribute) and (name := dotted(node.value.func)):
                if name in THREAD_STRONG or name in THREAD_WEAK:
                    yield row("thread_safety", f"uses {name}", 0.4 if name in THREAD_STRONG else 0.3, node.lineno)
                elif name.split(".")[-1][:1].isupper():
                    yield row("ownership", f"owns {name}", 0.4, node.lineno)


SCHEMAS = {
    symbols: "path string, name string, kind string, lineno int, parent string, docstring string, loc int, complexity int",
    imports: "path string, module string, name string, alias string, level int",
    class_references: "path string, owner string, raw string, type string",
    calls: "path string, caller string, owner string, callee string, receiver string, call_type string, line int",
    variable_types: "path string, function string, variable string, type string, confidence double",
    uml: "path string, owner string, kind string, name string, type string, optional boolean",
    findings: "path string, owner string, type string, value string, confidence double, line int",
}


def rows(files: DataFrame, generator: Callable[[str, str], Iterable[dict]], schema: str | None = None, path: str = "path", text: str = "text") -> DataFrame:
    """The rows that a generator makes of each file."""
    schema = schema or SCHEMAS[generator]
    names = [f.split()[0] for f in schema.split(", ")]
    kinds = [{"string": pa.string(), "int": pa.int32(), "double": pa.float64(), "long": pa.int64(), "boolean": pa.bool_()}[f.split()[1]] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, 512) for b in batches for i in range(0, max(1, b.num_rows), 512)):  # bounds the rows held as objects
            out = [r for p, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for r in generator(p, t or "")]
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in out], k) for n, k in zip(names, kinds, strict=True)], names=names)

    return files.select(path, text).mapInArrow(run, schema)
