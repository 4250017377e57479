"""Queries over source text: parsers, tokenizers, transcripts, contracts, resolution; and streams run to their end."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartolith.functions.hashing import fnv1a_32
from cartolith.operators import alignment, clones, contract_blocks, contracts, other_calls, resolution
from cartolith.sources import files, other_code, python_code, transcripts

from .registry import query, spread, table

#: Small programs that parse the same everywhere.
PROGRAMS = [
    ("app/main.py", "import os\nfrom app.store import Store, load as fetch\nfrom . import util\n\nclass App(Store):\n    '''Runs.'''\n    def __init__(self, store: Store):\n        self.store = Store()\n    def run(self, n: int) -> int:\n        if n > 0 and n < 9:\n            for i in range(n):\n                self.step(i)\n        return util.total(n)\n    def step(self, i):\n        s = Store()\n        s.put(i)\n        os.getcwd()\n        print(i)\n\ndef main():\n    fetch('x')\n    App(None).run(3)\n"),
    ("app/store.py", "class Base: pass\n\nclass Store(Base):\n    def open(self): pass\n    def close(self): pass\n    def put(self, x):\n        assert x is not None, 'x'\n        raise ValueError('must be set')\n\ndef load(name):\n    while True:\n        try:\n            return Store()\n        except OSError:\n            pass\n"),
    ("app/util.py", "def total(n):\n    return n\n"),
    ("app/bad.py", "def broken(:\n"),
    ("web/ui.ts", "// widgets\nexport class Panel extends View {\n  private n = 1;\n  draw(x: number): void {\n    if (x > 0 && this.n) { run(x); this.redo(x); Math.max(x, 1); }\n  }\n  redo(x: number): void { this.gone(); other.run(x); new Panel(); console.log(x); }\n  constructor() { }\n}\nexport function run(x: number) { return x ? 1 : 2; }\nconst twice = (x: number) => { return run(x) * 2; };\n"),
    ("native/core.cpp", "#include <vector>\n/* core */\nstruct Point { int x; int norm() const { return x > 0 ? x : -x; } };\ntypedef int Number;\nint add(int a, int b) {\n  for (int i = 0; i < b; ++i) { a++; }\n  return a;\n}\nclass Box {\n public:\n  int size() { return this->full() + add(1, 2); }\n  int full() { return Other::make(3) + std::max(1, 2) + item.weight(); }\n};\nint Box::make(int n) { return Box::make(n - 1) + printf(\"x\"); }\n"),
    ("web/page.html", '<html><body><div id="root"><my-card></my-card><p id="note">x</p></div></body></html>'),
    ("notes.txt", "nothing here\n"),
]


def programs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PROGRAMS, "path string, text string")


def projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The programs once for each supplier, in a folder of its own: sources in proportion to the tables."""
    files_ = F.array(*(F.struct(F.lit(p).alias("path"), F.lit(t).alias("text")) for p, t in PROGRAMS))
    root = F.concat(F.lit("p"), F.col("s_suppkey").cast("string"))
    each = spread(table(spark, sf_dir, "supplier").select("s_suppkey"), "s_suppkey").select(root.alias("root"), F.explode(files_).alias("f"))
    return each.select(F.concat_ws("/", "root", "f.path").alias("path"), F.replace("f.text", F.lit("from app."), F.concat(F.lit("from "), "root", F.lit(".app."))).alias("text"))


@query()
def python_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return python_code.rows(projects(spark, sf_dir).filter("path like '%.py'"), python_code.symbols)


@query()
def source_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return python_code.rows(projects(spark, sf_dir), other_code.any_symbols, other_code.SYMBOL_SCHEMA)


@query()
def source_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised tokens of all languages with the hash of their normal form."""
    code = projects(spark, sf_dir).withColumn("language", F.when(F.col("path").endswith(".py"), "python").when(F.col("path").rlike(r"\.[jt]sx?$"), "script").otherwise("c"))
    parts = [python_code.rows(code.filter(F.col("language") == k), lambda p, t, k=k: other_code.tokens(p, t, k), other_code.TOKEN_SCHEMA) for k in ("python", "script", "c")]
    return functools.reduce(DataFrame.unionByName, parts).withColumn("hash", fnv1a_32(F.col("normal")))


@query()
def python_call_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = projects(spark, sf_dir).filter("path like '%.py'")
    get = lambda g: python_code.rows(code, g)
    return resolution.resolve_calls(get(python_code.calls), get(python_code.symbols), get(python_code.imports), get(python_code.variable_types))


@query()
def script_call_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = projects(spark, sf_dir).filter("path like '%.ts'")
    return other_calls.resolve_script(python_code.rows(code, other_calls.script_calls, other_calls.CALL_SCHEMA), python_code.rows(code, other_code.script_symbols, other_code.SYMBOL_SCHEMA))


@query()
def native_call_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = projects(spark, sf_dir).filter("path like '%.cpp'")
    return other_calls.resolve_native(python_code.rows(code, other_calls.native_calls, other_calls.CALL_SCHEMA), python_code.rows(code, other_code.native_symbols, other_code.SYMBOL_SCHEMA))


@query()
def uml_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = projects(spark, sf_dir).filter("path like '%.py'")
    return resolution.uml_model(python_code.rows(code, python_code.uml), python_code.rows(code, python_code.symbols), python_code.rows(code, python_code.imports))


@query()
def uml_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes and edges of each kind."""
    return resolution.uml_stats(uml_model(spark, sf_dir))


@query()
def python_class_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = projects(spark, sf_dir).filter("path like '%.py'")
    return resolution.class_graph(python_code.rows(code, python_code.class_references), python_code.rows(code, python_code.symbols), python_code.rows(code, python_code.imports))


@query()
def python_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return python_code.rows(projects(spark, sf_dir).filter("path like '%.py'"), python_code.findings)


@query("""
    SELECT doc_id, CASE r WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 4 ELSE 5 END AS level, CASE r WHEN 0 THEN 'safe' WHEN 1 THEN lang || ' text' || repeat(chr(39), 3) WHEN 2 THEN 'KeyError' END AS value,
        CASE r WHEN 0 THEN 1.0 WHEN 1 THEN 0.7 WHEN 2 THEN 0.4 ELSE 0.0 END::DOUBLE AS confidence, CASE r WHEN 0 THEN 'safe' ELSE 'unknown' END AS thread_safety, CASE r WHEN 2 THEN 'KeyError' ELSE '' END AS errors
    FROM (SELECT doc_id, lang, doc_id % 4 AS r FROM documents)""")
def contract_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A function for each document, a quarter each with a block, a docstring, an exception and nothing."""
    r, name = F.col("doc_id") % 4, F.concat(F.lit("def f"), F.col("doc_id").cast("string"), F.lit("():\n"))
    body = F.when(r == 0, "    @contract\n    thread_safety: safe\n    @end").when(r == 1, F.concat(F.lit("    '''requires "), "lang", F.lit(" text'''"))).when(r == 2, "    raise KeyError").otherwise("    pass")
    return contracts.discover(table(spark, sf_dir, "documents").select("doc_id", F.concat(name, body).alias("source")), "doc_id", "source")


@query("""
    SELECT doc_id, 'def f():' || chr(10) || '    @contract' || chr(10) || '    thread_safety: ' || lang || chr(10) || '    @end' || chr(10) || '    return ' || doc_id AS written, 'def f():' || chr(10) || '    return ' || doc_id AS removed FROM documents""")
def contract_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract blocks written into functions, half of which have one, and taken out again."""
    old = F.when(F.col("doc_id") % 2 == 0, "    @contract\n    thread_safety: none\n    @end\n").otherwise("")
    source = F.concat(F.lit("def f():\n"), old, F.lit("    return "), F.col("doc_id").cast("string"))
    rows = table(spark, sf_dir, "documents").select("doc_id", source.alias("source"), F.concat(F.lit("    thread_safety: "), "lang").alias("block"))
    return rows.select("doc_id", contracts.with_block(F.col("source"), F.col("block")).alias("written"), contracts.without_block(F.col("source")).alias("removed"))


@query()
def program_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contracts.discover(projects(spark, sf_dir), "path", "text")


_BLOCK_CASES = """d AS (SELECT doc_id, coalesce(lang, 'x') AS lang, doc_id % 5 AS r FROM documents)"""


def contract_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, lang, path, text, line) of a function a document, in Python or C++: a fifth each with a whole block, one that
    is not closed, documentation only, nothing, and a block of few keys."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("lang", F.lit("x")).alias("lang"), (F.col("doc_id") % 5).alias("r"), (F.col("doc_id") % 2 == 0).alias("python"))
    ident = F.col("doc_id").cast("string")
    said = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    whole = said("thread_safety: immutable\nlifecycle: '", F.col("lang"), ": first'\npreconditions:\n  - n < ", ident, "\n  - [1, ", F.col("lang"), "]\nerrors: [E", ident, ', "F, G"]\nevidence:\n  - test: t.py::t', ident, "\n    policy: required\n  - other: x\n  - lint: ruff")
    block = F.when(F.col("r") == 0, whole).when(F.col("r") == 1, said("errors: [open, ", ident)).when(F.col("r") == 4, said("thread_safety: ", F.col("lang"), "\ninvariants: ~\ndependencies:\n- ", ident))
    marked = said(f"{contract_blocks.BEGIN}\n", block, f"\n{contract_blocks.END}")
    sections, tags = said("Head.\n\nArgs:\n  n: must be ", F.col("lang"), ". More.\nRaises:\n  E: ", ident), said("@pre n is ", F.col("lang"), "\n@throws E ", ident, "\nThis is not thread-safe.")
    documented = F.when(F.col("r") == 2, F.when(F.col("python"), sections).otherwise(tags))
    inner = F.coalesce(marked, documented)
    docstring = F.when(inner.isNull(), "").otherwise(said('    """\n', F.regexp_replace(inner, "(?m)^", "    "), '\n    """\n'))
    python = said("import x\n\ndef f", ident, "(n):\n", docstring, "    return n\n")
    comment = F.coalesce(F.regexp_replace(marked, "(?m)^", "// "), said("/**\n", F.regexp_replace(documented, "(?m)^", " * "), "\n */"), F.lit(""))
    native = said("#include <x>\n", comment, "\nint f", ident, "(int n) { return n; }\n")
    line = F.when(F.col("python"), 3).otherwise(F.regexp_count(native, F.lit("\n")))
    path = said("f", ident, F.when(F.col("python"), ".py").otherwise(".cpp"))
    return d.select("doc_id", "lang", path.alias("path"), F.when(F.col("python"), python).otherwise(native).alias("text"), line.cast("int").alias("line"))


@query(f"""
    WITH {_BLOCK_CASES}
    SELECT doc_id, CASE r WHEN 2 THEN 2 WHEN 3 THEN 5 ELSE 1 END AS level, CASE r WHEN 0 THEN 1.0 WHEN 2 THEN 0.8 WHEN 4 THEN 1.0 ELSE 0.0 END::DOUBLE AS confidence, r = 1 AS invalid,
        CASE WHEN r = 0 THEN 'immutable' WHEN r = 2 AND doc_id % 2 = 1 THEN 'not_safe' ELSE 'unknown' END AS thread_safety, CASE r WHEN 0 THEN lang || ': first' END AS lifecycle,
        CASE WHEN r = 0 THEN 'n < ' || doc_id || '|[1, ' || chr(39) || lang || chr(39) || ']' WHEN r = 2 AND doc_id % 2 = 0 THEN 'input must be ' || lang WHEN r = 2 THEN 'n is ' || lang ELSE '' END AS preconditions,
        CASE r WHEN 0 THEN 'E' || doc_id || '|F, G' WHEN 2 THEN CASE WHEN doc_id % 2 = 0 THEN 'E: ' || doc_id ELSE 'E: ' || doc_id || ' This is not thread-safe.' END ELSE '' END AS errors, CASE r WHEN 4 THEN doc_id::VARCHAR ELSE '' END AS dependencies,
        CASE r WHEN 0 THEN 'test t.py::t' || doc_id || ' required|lint ruff optional' ELSE '' END AS evidence FROM d""")
def contract_block_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contracts of functions by the strategy of their language: nested blocks, blocks that are not closed, documentation."""
    c = contract_blocks.read(contract_sources(spark, sf_dir))
    told = F.transform("evidence", lambda e: F.concat_ws(" ", e["type"], e["reference"], e["policy"]))
    lists = [F.array_join(x, "|").alias(x) for x in ("preconditions", "errors", "dependencies")]
    return c.select("doc_id", "level", "confidence", F.coalesce(F.col("note").startswith("invalid"), F.lit(False)).alias("invalid"), "thread_safety", "lifecycle", *lists, F.array_join(told, "|").alias("evidence"))


@query(f"""
    WITH {_BLOCK_CASES}
    SELECT doc_id, CASE WHEN r IN (0, 1, 4) THEN 'replaced' ELSE 'added' END AS how, true AS reads_back, true AS taken_out FROM d""")
def contract_block_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A contract written into each function: it reads back as it was, and taking it out leaves all other lines as they were."""
    rows = contract_sources(spark, sf_dir)
    struct = F.struct(F.lit("safe").alias("thread_safety"), F.concat("lang", F.lit(": x")).alias("lifecycle"), F.array(F.concat(F.lit("n > "), "doc_id"), F.lit("- a: 'b'")).alias("preconditions"))
    written = contract_blocks.rewrite(rows.withColumn("contract", struct), "contract").withColumnsRenamed({"rewritten": "after", "text": "before"})
    # In native sources the block stands above the symbol, which moves down by the block's lines.
    grown = F.regexp_count("after", F.lit("\n")) - F.regexp_count("before", F.lit("\n"))
    placed = written.withColumns({"text": F.col("after"), "line": F.when(F.col("path").endswith(".py"), F.col("line")).otherwise(F.col("line") + grown)})
    back = contract_blocks.read(placed)
    same = (F.col("thread_safety") == "safe") & (F.col("lifecycle") == F.concat("lang", F.lit(": x"))) & (F.col("preconditions") == F.col("contract.preconditions")) & (F.col("confidence") == 1.0)
    bare = contract_blocks.rewrite(back.select("doc_id", "path", "text", "line", "before", "after", same.alias("reads_back")), None)
    begun = F.contains("before", F.lit(contract_blocks.BEGIN))
    own = F.regexp_replace("before", f"(?s)[^\n]*{contract_blocks.BEGIN}.*{contract_blocks.END}[^\n]*", "")
    lines = lambda c: F.filter(F.split(c, "\n"), lambda x: ~F.trim(x).isin("", '"""'))
    return bare.select("doc_id", F.when(begun, "replaced").otherwise("added").alias("how"), "reads_back", (lines(F.col("rewritten")) == lines(own)).alias("taken_out"))


_PAGES = """SELECT page_id, '<section id="page-' || page_id || '">' || chr(10) || html || '</section>' AS html FROM pages"""


def _framed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages inside an element that has an id, since those of the tables have none."""
    head = F.concat(F.lit('<section id="page-'), F.col("page_id").cast("string"), F.lit('">\n'))
    return table(spark, sf_dir, "pages").select("page_id", F.concat(head, "html", F.lit("</section>")).alias("html"))


@query(f"""
    SELECT page_id, e AS name FROM (SELECT page_id, unnest(regexp_extract_all(html, '<[a-zA-Z][^>]*\\sid="([^"]+)"', 1)) AS e FROM ({_PAGES}))""")
def html_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = F.regexp_extract_all("html", F.lit(r'<[a-zA-Z][^>]*\sid="([^"]+)"'), F.lit(1))
    return _framed_pages(spark, sf_dir).select("page_id", F.explode(ids).alias("name"))


@query(f"""
    SELECT page_id || '.html' AS path, regexp_extract(e, '\\sid="([^"]+)"', 1) AS name, 'element' AS kind, 1 AS lineno, regexp_extract(e, '^<([a-zA-Z][a-zA-Z0-9-]*)', 1) AS parent, NULL::INTEGER AS complexity
    FROM (SELECT page_id, unnest(regexp_extract_all(html, '<[a-zA-Z][^>]*\\sid="[^"]+"')) AS e FROM ({_PAGES}))""")
def html_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _framed_pages(spark, sf_dir).select(F.concat(F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.col("html").alias("text"))
    return python_code.rows(pages, other_code.html_elements, other_code.SYMBOL_SCHEMA)


_MATCH = "CASE " + " ".join("WHEN regexp_matches(line, '{}') THEN '{}'".format(p.replace("'", "''"), "{}") for _, _, p in transcripts.FAMILIES) + " ELSE 'output' END"


@query(f"""
    WITH l AS (SELECT conv_id, turn, n AS line_number, trim(lines[n]) AS line FROM (SELECT conv_id, turn, lines, unnest(range(1, len(lines) + 1)) AS n FROM (SELECT conv_id, turn, string_split(text, chr(10)) AS lines FROM conversations)))
    SELECT conv_id, turn, line_number, {_MATCH.format(*(f for f, _, _ in transcripts.FAMILIES))} AS family, {_MATCH.format(*(k for _, k, _ in transcripts.FAMILIES))} AS type, line AS text FROM l WHERE NOT regexp_matches(line, '{transcripts.NOISE}')""")
def transcript_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcripts.events(table(spark, sf_dir, "conversations"), ["conv_id", "turn"], "text")


@query("""
    SELECT o_custkey AS log_id, 'h' || o_orderkey AS hash, 'a' || o_custkey AS author, strftime(o_orderdate, '%Y-%m-%d') AS day, count(l_partkey)::INT AS n_files
    FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_custkey, o_orderdate""")
def commit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commits written as log text, one log a customer, and parsed again."""
    header = F.concat_ws("|", F.concat(F.lit("h"), F.col("o_orderkey").cast("string")), F.concat(F.lit("a"), F.col("o_custkey").cast("string")), F.concat(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"), F.lit(" +0200")), F.lit("a|b"))
    names = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_join(F.collect_list(F.concat(F.lit("f"), F.col("l_partkey").cast("string"))), "\n").alias("names"))
    entry = F.concat_ws("\n", header, "names")
    orders = table(spark, sf_dir, "orders").join(names, "o_orderkey", "left")
    log = orders.groupBy(F.col("o_custkey").alias("log_id")).agg(F.array_join(F.collect_list(entry), "\n").alias("text"))
    out = files.commits_of_log(log)
    return out.select("log_id", "hash", "author", F.date_format("date", "yyyy-MM-dd").alias("day"), "n_files")


@query()
def alignment_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gap-tolerant similarity of each clone region's surroundings."""
    tokens = clones.text_tokens(table(spark, sf_dir, "documents"), "text", "doc_id")
    regions = clones.islands(clones.run_ends(clones.window_blocks(table(spark, sf_dir, "documents"), "text", "doc_id")), least=clones.MIN_TOKENS)
    return alignment.extend(regions, tokens)
