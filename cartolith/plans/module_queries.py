"""Queries over sources written from table values: syntax nodes, imports, and calls across files.

Each part gives a TypeScript module, a C++ header and source, and a Python file; names, sizes, re-exports and includes
come from its columns, so the SQL knows what every reference means.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartolith.llm.common import Scratch
from cartolith.operators import modules, other_calls, resolution
from cartolith.operators.graph import cut_lineage
from cartolith.sources import python_code, syntax

from .registry import query, spread, table


def _filled(template: str, **values: Column) -> Column:
    """A text with each {{name}} replaced by a column."""
    parts: list[Column] = []
    for piece in template.split("{{"):
        name, closed, rest = piece.partition("}}")
        parts += [values[name].cast("string"), F.lit(rest)] if closed else [F.lit(piece)]
    return F.concat(*parts)


SCRIPT_HEAD = "import { f{{t}} as go } from './m{{j}}';\nimport * as near from \"./m{{j}}\";\n"
SCRIPT_STAR = "export * from './m{{j}}';\n"
SCRIPT = """// part {{k}}
export class {{c}} extends Base {
  private n = 1;
  constructor(n: number) { super(); this.stop(n); }
  stop(n: number): void { if (n > {{s}} || /[)}"]/.test(`${n}`)) { console.log(`${this.stop(n - 1)} }`); } }
}
export const f{{k}} = async (n: number): Promise<number> => {
  {{calls}}new {{c}}(n); lost{{k}}(n);
  return n ? Math.max(n, 1) : {{s}};
};
"""
SCRIPT_CALLS = "go(n); near.f{{j}}(n); "

NATIVE_HEADER = "#pragma once\n{{include}}int area{{k}}(int n);\n"
NATIVE = """#include <vector>
#include "inc/h{{k}}.h"
namespace parts {
template <class T, int N = 3> struct {{c}} : public Base<T> {
  {{c}}(int a) : n_(a), m_{a} { }
  T size(int n) const noexcept override { return this->half(n); }
  T half(int n) const { return n > {{s}} && n ? n / 2 : {{s}}; }
  int n_, m_;
};
}
int area{{k}}(int n) {
  do { n--; } while (n > {{s}});
  return area{{t}}(n) + parts::gone<int>(n) + std::max(n, 1) + R"(area0( ")"[0];
}
"""

#: Parts with their number k, the one before (j) if there is one, and how far back a name is looked for (t).
_PARTS = """p AS (SELECT a.p_partkey AS k, b.p_partkey AS j, a.p_size AS s, replace(a.p_brand, '#', '') AS c, a.p_size % 2 = 0 AS passes FROM part a LEFT JOIN part b ON b.p_partkey = a.p_partkey - 1),
    g AS (SELECT *, sum(CASE WHEN passes AND j IS NOT NULL THEN 0 ELSE 1 END) OVER (ORDER BY k) AS gaps FROM p)"""


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("s"), F.replace("p_brand", F.lit("#"), F.lit("")).alias("c"))
    before = part.select((F.col("k") + 1).alias("k"), F.col("k").alias("j")).hint("merge")  # as many rows as `part`, though its file is small
    return spread(part.join(before, "k", "left"), "k")


def scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, text) of a TypeScript module a part, which imports from the one before and passes on its names if the size is even."""
    v = {n: F.col(n) for n in ("k", "j", "s", "c")} | {"t": F.greatest(F.lit(0), F.col("k") - 1 - F.col("s") % 5)}
    head = F.when(F.col("j").isNotNull(), F.concat(_filled(SCRIPT_HEAD, **v), F.when(F.col("s") % 2 == 0, _filled(SCRIPT_STAR, **v)).otherwise(""))).otherwise("")
    calls = F.when(F.col("j").isNotNull(), _filled(SCRIPT_CALLS, **v)).otherwise("")
    return _parts(spark, sf_dir).select(_filled("src/m{{k}}.ts", **v).alias("path"), F.concat(head, _filled(SCRIPT, **v, calls=calls)).alias("text"))


def natives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, text) of a header and a source a part; the header includes the one before if the size is even."""
    v = {n: F.col(n) for n in ("k", "j", "s", "c")} | {"t": F.greatest(F.lit(0), F.col("k") - F.col("s") % 5)}
    include = F.when(F.col("j").isNotNull() & (F.col("s") % 2 == 0), _filled('#include "h{{j}}.h"\n', **v)).otherwise("")
    both = F.array(F.struct(_filled("inc/h{{k}}.h", **v).alias("path"), _filled(NATIVE_HEADER, **v, include=include).alias("text")), F.struct(_filled("src/s{{k}}.cpp", **v).alias("path"), _filled(NATIVE, **v).alias("text")))
    return _parts(spark, sf_dir).select(F.explode(both).alias("f")).select("f.*")


def _nodes(code: DataFrame, generator) -> DataFrame:
    return python_code.rows(code, generator, syntax.NODE_SCHEMA)


def _linked(code: DataFrame, generator) -> DataFrame:
    """The nodes that names across files need, written once; a written table is smaller than its rows, so it is never broadcast."""
    return Scratch(code.sparkSession, "nodes").write(python_code.rows(code, other_calls.linked_nodes(generator), other_calls.LINKED_SCHEMA)).hint("merge")


#: Of syntax nodes what exports of modules need.
_TOP_SCHEMA = "path string, parent int, kind string, name string, source string, alias string, exported boolean"


def _top_nodes(path: str, text: str) -> list[dict]:
    return [r for r in syntax.script_nodes(path, text) if r["parent"] is None]


def script_calls_across(code: DataFrame) -> DataFrame:
    """Calls of TypeScript sources, resolved in their file or through imports and re-exports; each file is parsed once."""
    nodes = _linked(code, syntax.script_nodes)
    symbols = other_calls.symbols_of(nodes)
    found = modules.imported_functions(nodes, code.select("path"), other_calls.definitions(symbols, "."))
    return other_calls.resolve_script(other_calls.calls_of(nodes), symbols, found)


def native_calls_across(code: DataFrame) -> DataFrame:
    """Calls of C++ sources, resolved in their file or through what its includes declare; each file is parsed once."""
    nodes = _linked(code, syntax.native_nodes)
    symbols = other_calls.symbols_of(nodes)
    found = modules.included_functions(nodes, code.select("path"), other_calls.definitions(symbols, "::"))
    return other_calls.resolve_native(other_calls.calls_of(nodes), symbols, found)


_SCRIPT_CALLS_SQL = f"""
    WITH {_PARTS}, w AS (SELECT g.*, greatest(0, k - 1 - s % 5) AS t FROM g),
    hit AS (SELECT w.k, w.t, o.k IS NOT NULL AND b.gaps = o.gaps AS found FROM w LEFT JOIN g o ON o.k = w.t LEFT JOIN g b ON b.k = w.j WHERE w.j IS NOT NULL),
    r AS (
        SELECT k, 'constructor' AS caller, c AS owner, 'stop' AS callee, 'this' AS receiver, 'method' AS call_type, k AS tk, c || '.stop' AS target, 'resolved_project' AS status FROM p
        UNION ALL SELECT k, 'stop', c, 'test', NULL, 'method', NULL, NULL, 'unresolved' FROM p
        UNION ALL SELECT k, 'stop', c, 'log', 'console', 'method', NULL, NULL, 'ignored_builtin' FROM p
        UNION ALL SELECT k, 'stop', c, 'stop', 'this', 'method', k, c || '.stop', 'resolved_project' FROM p
        UNION ALL SELECT k, 'f' || k, NULL, c, NULL, 'constructor', k, c || '.constructor', 'resolved_project' FROM p
        UNION ALL SELECT k, 'f' || k, NULL, 'lost' || k, NULL, 'direct', NULL, NULL, 'unresolved' FROM p
        UNION ALL SELECT k, 'f' || k, NULL, 'max', 'Math', 'method', NULL, NULL, 'ignored_builtin' FROM p
        UNION ALL SELECT k, 'f' || k, NULL, 'f' || j, 'near', 'method', j, 'f' || j, 'resolved_project' FROM p WHERE j IS NOT NULL
        UNION ALL SELECT k, 'f' || k, NULL, 'go', NULL, 'direct', CASE WHEN found THEN t END, CASE WHEN found THEN 'f' || t END, CASE WHEN found THEN 'resolved_project' ELSE 'unresolved' END FROM hit)
    SELECT 'src/m' || k || '.ts' AS path, caller, owner, callee, receiver, call_type, 'src/m' || tk || '.ts' AS target_path, target, status FROM r"""

_NATIVE_CALLS_SQL = f"""
    WITH {_PARTS}, w AS (SELECT g.*, greatest(0, k - s % 5) AS t FROM g),
    hit AS (SELECT w.k, w.t, o.k IS NOT NULL AND w.gaps = o.gaps AS found FROM w LEFT JOIN g o ON o.k = w.t),
    r AS (
        SELECT k, 'size' AS caller, c AS owner, 'half' AS callee, 'this' AS receiver, 'method' AS call_type, k AS tk, c || '::half' AS target, 'resolved_project' AS status FROM p
        UNION ALL SELECT k, 'area' || k, NULL, 'area' || t, NULL, 'direct', CASE WHEN found THEN t END, CASE WHEN found THEN 'area' || t END, CASE WHEN found THEN 'resolved_project' ELSE 'unresolved' END FROM hit
        UNION ALL SELECT k, 'area' || k, NULL, 'gone', 'parts', 'static', NULL, NULL, 'ignored_third_party' FROM p
        UNION ALL SELECT k, 'area' || k, NULL, 'max', 'std', 'static', NULL, NULL, 'ignored_stdlib' FROM p)
    SELECT 'src/s' || k || '.cpp' AS path, caller, owner, callee, receiver, call_type, 'src/s' || tk || '.cpp' AS target_path, target, status FROM r"""


@query(_SCRIPT_CALLS_SQL)
def script_module_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls across TypeScript modules: named, namespace and renamed imports through chains of re-exports."""
    return script_calls_across(scripts(spark, sf_dir)).drop("line")


@query(_NATIVE_CALLS_SQL)
def native_include_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls across C++ files: declarations in headers reached through includes, bodies in the sources that include those."""
    return native_calls_across(natives(spark, sf_dir)).drop("line")


_EDGES = "SELECT path || '::' || coalesce(owner || '.', '') || caller AS source, target_path || '::' || target AS target FROM ({}) WHERE status = 'resolved_project'"


def _totals_sql(language: str, calls: str) -> str:
    return (
        f"SELECT '{language}' AS language, (SELECT count(DISTINCT path) FROM ({calls})) AS analysed_files, (SELECT count(DISTINCT e) FROM (SELECT unnest([source, target]) AS e FROM ({_EDGES.format(calls)}))) AS functions, "
        f"(SELECT count(*) FROM (SELECT DISTINCT * FROM ({_EDGES.format(calls)}))) AS edges, (SELECT count(DISTINCT source) FROM ({_EDGES.format(calls)}) WHERE source NOT IN (SELECT target FROM ({_EDGES.format(calls)}))) AS entry_points"
    )


@query(f"{_totals_sql('script', _SCRIPT_CALLS_SQL)} UNION ALL {_totals_sql('native', _NATIVE_CALLS_SQL)}")
def cross_file_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files, functions, edges and entry points of the call graphs of both languages."""
    graphs = {"script": script_calls_across(scripts(spark, sf_dir)), "native": native_calls_across(natives(spark, sf_dir))}
    rows = [modules.graph_totals(calls).select(F.lit(name).alias("language"), "*") for name, calls in graphs.items()]
    return rows[0].unionByName(rows[1])


@query(f"""
    WITH {_PARTS}, r AS (
        SELECT k, f.kind, f.name, f.parent, f.line, f.end_line, f.complexity, NULL AS doc FROM (SELECT *, CASE WHEN j IS NULL THEN 0 WHEN passes THEN 3 ELSE 2 END AS h FROM p), LATERAL (VALUES
            ('class', c, NULL, h + 2, h + 6, NULL), ('method', 'constructor', c, h + 4, h + 4, 1), ('method', 'stop', c, h + 5, h + 5, 3),
            ('function', 'f' || k, NULL, h + 7, h + 10, 2)) f (kind, name, parent, line, end_line, complexity))
    SELECT 'src/m' || k || '.ts' AS path, kind, name, parent, line::INT AS line, end_line::INT AS end_line, complexity, CASE WHEN kind = 'class' THEN 'part ' || k END AS doc FROM r
    UNION ALL SELECT 'src/s' || k || '.cpp', f.kind, f.name, f.parent, f.line, f.end_line, f.complexity, NULL FROM p, LATERAL (VALUES
            ('class', c, NULL, 4, 9, NULL), ('method', c, c, 5, 5, 1), ('method', 'size', c, 6, 6, 1), ('method', 'half', c, 7, 7, 3), ('function', 'area' || k, NULL, 11, 14, 2)) f (kind, name, parent, line, end_line, complexity)""")
def syntax_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declarations of TypeScript and C++ sources with their lines, complexity and leading comment."""
    rows = _nodes(scripts(spark, sf_dir), syntax.script_nodes).unionByName(_nodes(natives(spark, sf_dir), syntax.native_nodes))
    parent = F.when(F.col("kind") == "method", F.col("owner"))
    return rows.filter("kind in ('class', 'function', 'method')").select("path", "kind", "name", parent.alias("parent"), "line", "end_line", "complexity", "doc")


@query(f"""
    WITH {_PARTS}
    SELECT 'src/m' || a.k || '.ts' AS path, 'f' || b.k AS name, 'src/m' || b.k || '.ts' AS def_path FROM g a JOIN g b ON b.k <= a.k AND a.gaps = b.gaps
    UNION ALL SELECT DISTINCT 'src/m' || a.k || '.ts', b.c, first_value('src/m' || b.k || '.ts') OVER (PARTITION BY a.k, b.c ORDER BY b.k DESC) FROM g a JOIN g b ON b.k <= a.k AND a.gaps = b.gaps""")
def module_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each module exports, its own names and those of the modules that it passes on, with where each is defined.

    A class of the same brand nearer in the chain hides one further off.
    """
    code = scripts(spark, sf_dir)
    nodes = Scratch(spark, "top").write(python_code.rows(code, _top_nodes, _TOP_SCHEMA)).hint("merge")
    return modules.script_exports(nodes, modules.script_links(nodes, code)).select("path", "name", "def_path")


_PACKAGE = "'pkg' || k % 7 || '/m' || k || CASE WHEN s % 2 = 0 THEN '.py' ELSE '/__init__.py' END"


@query(f"""
    WITH p AS (SELECT p_partkey AS k, p_size AS s FROM part), f AS (SELECT k, {_PACKAGE} AS path FROM p), r AS (
        SELECT k, s, 'm' || (k + 7) AS module, NULL AS name, 0 AS level, CASE WHEN s % 2 = 0 THEN k + 7 END AS wanted FROM p
        UNION ALL SELECT k, s, 'pkg' || (k + 1) % 7 || '.m' || (k + 1), 'x', 0, k + 1 FROM p
        UNION ALL SELECT k, s, 'm' || (k + 14), 'x', 1, CASE WHEN s % 2 = 0 THEN k + 14 END FROM p
        UNION ALL SELECT k, s, NULL, 'm' || (k + 7), 1, CASE WHEN s % 2 = 0 THEN k + 7 END FROM p
        UNION ALL SELECT k, s, 'm' || (k + 7), 'x', 2, CASE WHEN s % 2 = 1 THEN k + 7 END FROM p
        UNION ALL SELECT k, s, 'os.path', NULL, 0, NULL FROM p)
    SELECT f.path, r.module, r.name, r.level, t.path AS target FROM r JOIN f USING (k) LEFT JOIN f t ON t.k = r.wanted""")
def import_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imports of Python files with the file that each means: beside the file, at the root, or where its dots lead."""
    part = spread(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("s")), "k")
    path = F.concat(F.lit("pkg"), F.col("k") % 7, F.lit("/m"), F.col("k"), F.when(F.col("s") % 2 == 0, ".py").otherwise("/__init__.py"))
    files = part.select(path.alias("path"), "k")
    name = lambda by: F.concat(F.lit("m"), F.col("k") + by)
    ref = lambda module, what, level: F.struct(module.cast("string").alias("module"), what.cast("string").alias("name"), F.lit(level).alias("level"))
    none, x = F.lit(None), F.lit("x")
    root = F.concat(F.lit("pkg"), (F.col("k") + 1) % 7, F.lit("."), name(1))
    refs = files.select("path", F.explode(F.array(ref(name(7), none, 0), ref(root, x, 0), ref(name(14), x, 1), ref(none, name(7), 1), ref(name(7), x, 2), ref(F.lit("os.path"), none, 0))).alias("r")).select("path", "r.*")
    return modules.existing(refs, files, modules.python_candidates(F.col("path"), F.col("module"), F.col("name"), F.col("level")))


PYTHON_HEAD = "from pkg.m{{j}} import helper{{j}} as go\nimport pkg.m{{j}} as near\n"
PYTHON = '''class {{c}}(Base):
    """Part {{k}}."""

    def __init__(self, n: int):
        self.n = n
        self.check(n)

    def check(self, n):
        if n > {{s}} and n:
            return n
        for i in range(n):
            while i:
                i -= 1
        return helper{{k}}(n)


def helper{{k}}(n):
    {{calls}}{{c}}(n)
    missing{{k}}(n)
    print(n)
    return n
'''
PYTHON_CALLS = "go(n); near.helper{{j}}(n); "


def pythons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, text) of a Python module a part, which imports a function and the module of the part before."""
    v = {n: F.col(n) for n in ("k", "j", "s", "c")}
    there = F.col("j").isNotNull()
    return _parts(spark, sf_dir).select(_filled("pkg/m{{k}}.py", **v).alias("path"), F.concat(F.when(there, _filled(PYTHON_HEAD, **v)).otherwise(""), _filled(PYTHON, **v, calls=F.when(there, _filled(PYTHON_CALLS, **v)).otherwise(""))).alias("text"))


@query(f"""
    WITH {_PARTS}
    SELECT 'pkg/m' || k || '.py' AS path, f.kind, f.name, f.parent, (f.lineno + CASE WHEN j IS NULL THEN 0 ELSE 2 END)::INT AS lineno, f.loc::INT AS loc, f.complexity::INT AS complexity, CASE WHEN f.kind = 'class' THEN 'Part ' || k || '.' END AS docstring
    FROM p, LATERAL (VALUES ('class', c, NULL, 1, NULL, NULL), ('method', '__init__', c, 4, 3, 1), ('method', 'check', c, 8, 7, 5), ('function', 'helper' || k, NULL, 17, 5, 1)) f (kind, name, parent, lineno, loc, complexity)""")
def python_module_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols of Python modules with their lines, complexity and docstring."""
    return python_code.rows(pythons(spark, sf_dir), python_code.symbols)


@query(f"""
    WITH {_PARTS}, r AS (
        SELECT k, c || '.__init__' AS caller, 'check' AS callee, 'self' AS receiver, 'pkg/m' || k || '.py:' || c || '.check' AS target, 'resolved_project' AS status FROM p
        UNION ALL SELECT k, c || '.check', 'range', NULL, NULL, 'ignored_builtin' FROM p
        UNION ALL SELECT k, c || '.check', 'helper' || k, NULL, 'pkg/m' || k || '.py:helper' || k, 'resolved_project' FROM p
        UNION ALL SELECT k, 'helper' || k, 'go', NULL, 'pkg/m' || j || '.py:helper' || j, 'resolved_project' FROM p WHERE j IS NOT NULL
        UNION ALL SELECT k, 'helper' || k, 'helper' || j, 'near', 'pkg/m' || j || '.py:helper' || j, 'resolved_project' FROM p WHERE j IS NOT NULL
        UNION ALL SELECT k, 'helper' || k, c, NULL, 'pkg/m' || k || '.py:' || c, 'resolved_project' FROM p
        UNION ALL SELECT k, 'helper' || k, 'missing' || k, NULL, NULL, 'unresolved' FROM p
        UNION ALL SELECT k, 'helper' || k, 'print', NULL, NULL, 'ignored_builtin' FROM p)
    SELECT 'pkg/m' || k || '.py' AS path, caller, callee, receiver, target, status FROM r""")
def python_module_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls across Python modules, by imported names and through imported modules."""
    code = cut_lineage(pythons(spark, sf_dir))
    get = lambda g: python_code.rows(code, g)
    found = resolution.resolve_calls(get(python_code.calls), get(python_code.symbols), get(python_code.imports), get(python_code.variable_types))
    return found.select("path", "caller", "callee", "receiver", "target", "status")


@query(f"""
    WITH {_PARTS}
    SELECT 'pkg.m' || k || '.' || c AS source, 'Base' AS target, 'inherits' AS type, false AS internal FROM p""")
def python_module_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between the classes of Python modules."""
    code = pythons(spark, sf_dir)
    get = lambda g: python_code.rows(code, g)
    return resolution.class_graph(get(python_code.class_references), get(python_code.symbols), get(python_code.imports))


@query(f"""
    WITH {_PARTS}
    SELECT 'app.m' || k || '.' || c AS source, 'app.m' || j || '.Part' || j AS target FROM p WHERE j IS NOT NULL
    UNION ALL SELECT 'app.m' || k || '.Part' || k, 'app.m' || k || '.' || c FROM p""")
def internal_inheritance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inheritance between classes of the program: a class of another module under its imported name, and one of the own."""
    v = {n: F.col(n) for n in ("k", "j", "c")}
    head = F.when(F.col("j").isNotNull(), _filled("from app.m{{j}} import Part{{j}} as Before\n", **v)).otherwise("")
    base = F.when(F.col("j").isNotNull(), "Before").otherwise("Base")
    body = _filled("class {{c}}({{base}}):\n    other: Other\n\n\nclass Part{{k}}({{c}}):\n    def make(self):\n        return Thing()\n", **v, base=base)
    code = _parts(spark, sf_dir).select(_filled("app/m{{k}}.py", **v).alias("path"), F.concat(head, body).alias("text"))
    get = lambda g: python_code.rows(code, g)
    edges = resolution.class_graph(get(python_code.class_references), get(python_code.symbols), get(python_code.imports))
    return resolution.edges_of(edges, ["inherits"], internal_only=True).select("source", "target")
