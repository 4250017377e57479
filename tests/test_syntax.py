"""Syntax nodes by construct, imports and exports, and calls across files, against expectations written by hand or brute force."""

import random

import pytest

from cartolith.operators import modules, other_calls
from cartolith.sources import python_code, syntax


def found(language, text, kind=None):
    rows = list((syntax.script_nodes if language == "ts" else syntax.native_nodes)("p", text))
    for k, row in enumerate(rows):
        assert row["id"] == k and (row["parent"] is None or row["parent"] < k) and row["end_line"] >= row["line"]
    return [r for r in rows if kind is None or r["kind"] == kind]


def names(language, text, *kinds):
    return [(r["kind"], r["owner"] if r["kind"] == "method" else None, r["name"]) for r in found(language, text) if r["kind"] in kinds]


DECLARED = "class", "function", "method", "namespace"


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("function a() {}\nasync function* b<T extends {x: 1}>(q: T): AsyncGenerator<T> {}", [("function", None, "a"), ("function", None, "b")]),
        ("export default function () { go(); }", [("function", None, "default")]),
        ("const f = (x: number): Map<string, () => void> => { g(x); }, h = async y => y + 1, i = function named() {};", [("function", None, n) for n in "fhi"]),
        ("let v: (a: number) => void = (a) => {};", [("function", None, "v")]),
        ("const n = a < b ? (c) : d; const o = (1 + 2) * 3;", []),
        ("abstract class A<T> extends B<T> implements C, D { constructor(private x = 1) { super(); } static async *m<K>(k: K) {} get p(): number { return 1; } abstract q(): void; r?: string; s = () => 1; #t() {} }",
         [("class", None, "A"), ("method", "A", "constructor"), ("method", "A", "m"), ("method", "A", "p"), ("method", "A", "#t")]),
        ("@Dec({ a: [1, 2] }) export class E { @In() @Out.x(1) f(@P() a: string): { b: number } { return { b: 1 }; } }", [("class", None, "E"), ("method", "E", "f")]),
        ("namespace N.M { export class O { p() {} } }", [("namespace", None, "N.M"), ("class", None, "O"), ("method", "O", "p")]),
        ("const o = { m(a) { return 1; }, get g() { return 2; }, k: function (x) {}, ...rest };", [("function", None, "m"), ("function", None, "g")]),
        ("interface I { m(): void; n(x: number): string }\ntype T = { f(): void };\nenum En { A, B }\nfunction after() {}", [("function", None, "after")]),
        ("const t = `a ${b(`c ${d()} }`)} { }`; function e() {}", [("function", None, "e")]),
        ("if (x) /re(/.test(y); a = b / c / d; function e() { return /[/\\]}]{2}/g; } function f() {}", [("function", None, "e"), ("function", None, "f")]),
        ("let broken = ((({[;\nfunction f() { if (x { y(); } }\nfunction g() {}", [("function", None, "f"), ("function", None, "g")]),
    ],
)
def test_script_declarations(text, want):
    assert names("ts", text, *DECLARED) == want


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("static inline unsigned long long f(const std::map<int, char*>& m, int (*cb)(int), ...) noexcept(true) { return 1; }", [("function", None, "f")]),
        ("template <typename T, int N = (3 > 2)> class A final : public B<T>, private C { public: A() : x(1), y{2}, B<T>(3) {} virtual ~A() = default; T m(int) const& override; private: int x, y; };\ntemplate <class T, int N> T A<T, N>::m(int a) const& { return a; }",
         [("class", None, "A"), ("method", "A", "A"), ("method", "A", "m")]),
        ("namespace a::b { inline namespace v1 { struct S { struct T { int g() { return 1; } }; bool operator<(const S& o) const { return true; } explicit operator bool() const { return true; } void operator()(int x) {} }; } }",
         [("namespace", None, "a::b"), ("namespace", None, "v1"), ("class", None, "S"), ("class", None, "T"), ("method", "T", "g"), ("method", "S", "operator<"), ("method", "S", "operatorbool"), ("method", "S", "operator()")]),
        ("typedef struct { int x; } P; typedef int (*H)(int, char); typedef std::vector<std::pair<int, int>> V; enum class C : char { Red, Green }; union U { int a; float b; };", [("class", None, n) for n in ("P", "H", "V", "C", "U")]),
        ("auto f(int x) -> decltype(g(x)) { return g(x); }\nint Outer::Inner::h() { return 0; }\nOuter::~Outer() { }", [("function", None, "f"), ("method", "Inner", "h"), ("method", "Outer", "~Outer")]),
        ("#define F(x) void x() {\nint a = f(3); int b{4}; std::string s(\"x\"); const char* r = R\"x(int g() { )x\"; char c = '{';\nint k() { return 0; }", [("function", None, "k")]),
        ("extern \"C\" { int c(void) { return 1; } }\nint d(int a)\n#ifdef X\n{ return 1; }\n#endif\n", [("function", None, "c")]),
        ("class Fwd; struct Fwd2 *p; class API_EXPORT Named { void m() {} };", [("class", None, "Named"), ("method", "Named", "m")]),
        ("int broken( { ;\n}\nint ok() { return 1; }", [("function", None, "broken"), ("function", None, "ok")]),
    ],
)
def test_native_declarations(text, want):
    assert names("cpp", text, *DECLARED) == want


def test_calls_receivers_and_functions():
    text = """
    class A { m() { this.x(); a.b.c(); f<string>(g()); new N.P(h()); q?.r?.(1); s().t(); u[v()].w(); super.y(); if (z()) {} } }
    const k = () => [1].map(x => inner(x));
    top();
    """
    got = [(r["receiver"], r["name"], r["how"]) for r in found("ts", text, "call")]
    want = [("this", "x", "method"), ("a.b", "c", "method"), (None, "f", "direct"), (None, "g", "direct"), (None, "N.P", "constructor"), (None, "h", "direct"), ("q", "r", "method"), (None, "s", "direct"),
            ("s", "t", "method"), (None, "v", "direct"), ("u", "w", "method"), ("super", "y", "method"), (None, "z", "direct"), (None, "map", "method"), (None, "inner", "direct"), (None, "top", "direct")]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert [r["name"] for r in found("ts", text, "call") if r["function"] is None] == ["top"]
    native = "int f() { a->b.c(1); A::B::d(); e<int>(g()); T x(1); return new Q(h()) ? this->i() : j(k); }"
    got = [(r["receiver"], r["name"], r["how"]) for r in found("cpp", native, "call")]
    assert got == [("a.b", "c", "method"), ("A::B", "d", "static"), (None, "e", "direct"), (None, "g", "direct"), (None, "h", "direct"), ("this", "i", "method"), (None, "j", "direct")]


def test_complexity_lines_and_comments():
    text = "/* first\n * second */\nfunction f(a?: number) {\n  do { if (a && b) {} else if (c || d) {} } while (e);\n  switch (g) { case 1: case 2: break; default: }\n  for (const x of y) {} while (1) {}\n  try {} catch (h) {}\n  return a?.b ?? (i ? 1 : 2);\n}\n\n\n// far\n\nfunction g() {}\nlet z; // no\nfunction h() {}"
    rows = {r["name"]: r for r in found("ts", text, "function")}
    assert (rows["f"]["complexity"], rows["f"]["line"], rows["f"]["end_line"], rows["f"]["doc"]) == (12, 3, 9, "first second")
    assert rows["g"]["doc"] == "far" and rows["h"]["doc"] is None
    native = found("cpp", "// sums\nint f(int a) {\n  for (int i = 0; i < a; ++i) { if (i || a) continue; }\n  do { a--; } while (a);\n  switch (a) { case 1: break; }\n  try { } catch (...) { }\n  return a ? 1 : 2;\n}", "function")[0]
    assert (native["complexity"], native["end_line"], native["doc"]) == (8, 8, "sums")


def test_imports_and_exports():
    text = "import d, { a as b, type C } from './m';\nimport * as n from \"../n\";\nimport './side';\nimport type { T } from './t';\nexport { x as y, z } from './o';\nexport * from './s';\nexport * as w from './w';\nexport { b as out, local };\nexport default class K {}\nconst lazy = import('./l');"
    assert [(r["name"], r["alias"], r["source"], r["how"]) for r in found("ts", text, "import")] == [
        ("default", "d", "./m", "named"), ("a", "b", "./m", "named"), ("C", "C", "./m", "named"), ("*", "n", "../n", "named"), (None, None, "./side", "effect"), ("T", "T", "./t", "named"), (None, None, "./l", "dynamic")]
    assert [(r["name"], r["alias"], r["source"]) for r in found("ts", text, "export")] == [
        ("x", "y", "./o"), ("z", "z", "./o"), ("*", None, "./s"), ("*", "w", "./w"), ("b", "out", None), ("local", "local", None), ("K", "default", None)]
    assert [(r["source"], r["how"]) for r in found("cpp", '#include <a/b.h>\n #  include "c.h" // x\nint f() {\n#include "in.inc"\n}', "import")] == [("a/b.h", "system"), ("c.h", "named"), ("in.inc", "named")]


def test_any_text_gives_rows_and_ends():
    rng = random.Random(5)
    parts = ["class", "A", "{", "}", "(", ")", "<", ">", "`", "${", "'", '"', "/", "//", "/*", "*/", "\n", "function", "=>", "=", ":", ";", ",", "namespace", "template", "#include", "operator", "~", "::", ".", "new", "import", "export", "from", "*", "do", "while", "x", "1", "[", "]", "?", "typedef", "struct", "é", "\\"]
    for _ in range(1500):
        text = " ".join(rng.choice(parts) for _ in range(rng.randrange(40)))
        found("ts", text)
        found("cpp", text)


def test_paths(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("a/b/c.ts", "../x"), ("a.ts", "./y/./z"), ("a.ts", "../x"), ("a/b.ts", "lib")], "path string, source string")
    got = [(r[0], (r[1] or [None, None])[1]) for r in df.select(modules.normalised(F.concat_ws("/", modules.folder(F.col("path")), "source")), modules.script_candidates(F.col("path"), F.col("source"))).collect()]
    assert got == [("a/x", "a/x.ts"), ("y/z", "y/z.ts"), (None, None), ("a/lib", None)]
    files = spark.createDataFrame([("a/x.tsx",), ("a/x.js",), ("y/z/index.ts",), ("p/m.ts",)], "path string")
    refs = spark.createDataFrame([("a/b/c.ts", "../x"), ("a.ts", "./y/z"), ("p/q.ts", "./m.js"), ("p/q.ts", "./none")], "path string, source string")
    found_ = modules.existing(refs, files, modules.script_candidates(F.col("path"), F.col("source")))
    assert {(r["path"], r["source"]): r["target"] for r in found_.collect()} == {("a/b/c.ts", "../x"): "a/x.tsx", ("a.ts", "./y/z"): "y/z/index.ts", ("p/q.ts", "./m.js"): "p/m.ts", ("p/q.ts", "./none"): None}


FILES = {
    "src/core.ts": "export function run() { return 1; }\nfunction hidden() {}\nexport class Box { constructor() {} open() { this.shut(); } shut() {} }\nexport default function main() { run(); }",
    "src/mid/index.ts": "import { run } from '../core';\nexport { run as go };\nexport { Box } from '../core';\nexport { default as start } from '../core';\nexport const own = () => 1;",
    "src/all.ts": "export * from './mid';\nexport * from './ring';\nexport function own() { return 2; }",
    "src/ring.ts": "export * from './all';\nexport function ringed() { return 1; }",
    "src/use.ts": "import main, { run as r } from './core';\nimport * as every from './all';\nimport { go, start, own, Box as B, hidden, nothing } from './all';\nfunction use() { r(); main(); go(); start(); own(); every.ringed(); every.go(); new B(); hidden(); nothing(); every.Box.open(); lib(); }",
}


def test_script_calls_across_files(spark):
    from cartolith.plans.module_queries import script_calls_across

    code = spark.createDataFrame(list(FILES.items()), "path string, text string")
    got = {(r["caller"], r["receiver"], r["callee"]): (r["target_path"], r["target"]) if r["status"] == "resolved_project" else r["status"] for r in script_calls_across(code).collect()}
    core, want = "src/core.ts", "unresolved"
    assert got == {
        ("main", None, "run"): (core, "run"), ("open", "this", "shut"): (core, "Box.shut"), ("use", None, "r"): (core, "run"), ("use", None, "main"): (core, "main"), ("use", None, "go"): (core, "run"),
        ("use", None, "start"): (core, "main"), ("use", None, "own"): ("src/all.ts", "own"), ("use", "every", "ringed"): ("src/ring.ts", "ringed"), ("use", "every", "go"): (core, "run"),
        ("use", None, "B"): (core, "Box.constructor"), ("use", None, "hidden"): want, ("use", None, "nothing"): want, ("use", "every.Box", "open"): (core, "Box.open"), ("use", None, "lib"): want,
    }


def test_native_calls_across_files(spark):
    from cartolith.plans.module_queries import native_calls_across

    code = {
        "inc/a.h": '#include "b.h"\nint declared(int);\nstruct P { static int make(int n) { return n; } };\ninline int quick() { return 1; }',
        "inc/b.h": '#include "a.h"\nint deep(void);',
        "src/a.cpp": '#include "../inc/a.h"\nint declared(int n) { return n; }\nint deep(void) { return quick(); }',
        "src/b.cpp": '#include "inc/a.h"\nstatic int local() { return 1; }\nint main() { local(); declared(1); deep(); quick(); P::make(2); Q::make(3); unseen(); obj.method(); std::sort(x); return 0; }',
        "src/c.cpp": "int unseen() { return declared(1); }",
    }
    got = {(r["path"], r["caller"], r["callee"], r["receiver"]): (r["target_path"], r["target"]) if r["status"] == "resolved_project" else r["status"] for r in native_calls_across(spark.createDataFrame(list(code.items()), "path string, text string")).collect()}
    b = "src/b.cpp"
    assert got == {
        ("src/a.cpp", "deep", "quick", None): ("inc/a.h", "quick"), (b, "main", "local", None): (b, "local"), (b, "main", "declared", None): ("src/a.cpp", "declared"), (b, "main", "deep", None): ("src/a.cpp", "deep"),
        (b, "main", "quick", None): ("inc/a.h", "quick"), (b, "main", "make", "P"): ("inc/a.h", "P::make"), (b, "main", "make", "Q"): "ignored_third_party", (b, "main", "unseen", None): "unresolved",
        (b, "main", "method", "obj"): "unresolved", (b, "main", "sort", "std"): "ignored_stdlib", ("src/c.cpp", "unseen", "declared", None): "unresolved",
    }


def test_exports_of_random_graphs(spark):
    """Names through stars and aliases, cycles included, against a walk in Python."""
    rng = random.Random(8)
    own = {(f"m{k}", f"n{k}_{i}") for k in range(25) for i in range(2)}
    stars = {(f"m{rng.randrange(25)}", f"m{rng.randrange(25)}") for _ in range(30)}
    aliases = {}
    for _ in range(20):
        k, j = rng.randrange(25), rng.randrange(25)
        aliases[f"m{k}", f"x{rng.randrange(6)}"] = (f"m{j}", rng.choice([f"n{j}_0", f"x{rng.randrange(6)}"]))
    want = {(m, n): (m, n) for m, n in own}
    changed = True
    while changed:
        changed = False
        new = {key: want[to] for key, to in aliases.items() if to in want and key not in want}
        for m, to in sorted(stars):
            for (t, n), d in want.items():
                if t == to and (m, n) not in want and (m, n) not in aliases and (m, n) not in own:
                    new[m, n] = min(new.get((m, n), d), d)
        changed = bool(new)
        want |= new
    frame = lambda rows, cols: spark.createDataFrame(sorted(rows), cols)
    got = modules.exported(frame({(m, n, m, n) for m, n in own}, "path string, name string, def_path string, def_name string"), frame({(*k, *v) for k, v in aliases.items()}, "path string, name string, target string, target_name string"), frame(stars, "path string, target string"))
    assert {(r["path"], r["name"]): (r["def_path"], r["def_name"]) for r in got.collect()} == want


def test_totals_and_file_bound(spark):
    from cartolith.plans.module_queries import script_calls_across

    calls = script_calls_across(spark.createDataFrame(list(FILES.items()), "path string, text string"))
    row = modules.graph_totals(calls, max_files=2).first()
    edges = {(r["source"], r["target"]) for r in modules.call_graph(calls).collect()}
    assert (row["edges"], row["functions"], row["entry_points"]) == (len(edges), len({x for e in edges for x in e}), len({a for a, _ in edges} - {b for _, b in edges}))
    with pytest.raises(ValueError):
        modules.graph_totals(calls, max_files=1)


def test_symbols_and_calls_are_queries_on_nodes(spark):
    code = spark.createDataFrame(list(FILES.items()), "path string, text string")
    nodes = python_code.rows(code, syntax.script_nodes, syntax.NODE_SCHEMA)
    direct = python_code.rows(code, other_calls.script_calls, other_calls.CALL_SCHEMA)
    assert sorted(map(tuple, other_calls.calls_of(nodes).collect()), key=repr) == sorted(map(tuple, direct.collect()), key=repr)
