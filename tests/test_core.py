"""Unit tests of the core operators on small tables."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cartolith.functions import hashing
from cartolith.functions import text as tx
from cartolith.operators import alignment, clones, contracts, drift, events, graph, joins, metrics, resolution, search
from cartolith.plans.parser_queries import PROGRAMS
from cartolith.sources import files, other_code, python_code, transcripts


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.select(*columns).collect())


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first()


def fnv(text):
    h = 2166136261
    for b in text.encode():
        h = (h ^ b) * 16777619 % 2**32
    return h


def test_fnv_and_window_hashes(spark):
    rng = random.Random(0)
    words = ["", "$ID", "a", "hello"]
    df = spark.createDataFrame([(w,) for w in words], "w string").select("w", hashing.fnv1a_32(F.col("w")).alias("h"))
    assert {r["w"]: r["h"] for r in df.collect()} == {w: fnv(w) for w in words}
    for n in (0, 9, 10, 25):
        values = [rng.randrange(2**32) for _ in range(n)]
        got = spark.createDataFrame([(values,)], "v array<long>").select(hashing.window_hashes(F.col("v")).alias("h")).first()["h"]
        want = []
        for i in range(n - 9):
            h = 0
            for x in values[i : i + 10]:
                h = (h * 31 + x) % 1000000009
            want.append(h)
        assert got == want


@pytest.mark.parametrize(
    ("pattern", "path", "hit"),
    [("**/*.py", "a/b/c.py", True), ("src/*.py", "src/a.py", True), ("src/*.py", "src/b/a.py", False), ("*.PY", "x.py", True), ("a?c", "abc", True), ("a?c", "a/c", False), ("a.c", "abc", False)],
)
def test_glob(spark, pattern, path, hit):
    assert one(spark, hit=F.lit(path).rlike(tx.glob_to_regex(pattern)))["hit"] is hit


def test_scalars(spark):
    r = one(
        spark,
        cut=tx.truncate(F.lit("x" * 61), 60), kept=tx.truncate(F.lit("x" * 60), 60), label=tx.status_label(F.lit("RM")), new=tx.status_label(F.lit("??")), odd=tx.status_label(F.lit("  ")),
        opt=tx.base_type(F.lit("Optional[Foo]")), uni=tx.base_type(F.lit("Union[A, B]")), bar=tx.base_type(F.lit("X | None")), lst=tx.base_type(F.lit("List[int]")),
        pascal=tx.is_pascal_case(F.lit("MyClass")), not_pascal=tx.is_pascal_case(F.lit("myClass")), rel=tx.resolve_relative(F.lit("a.b.c"), F.lit("d"), F.lit(1)), up=tx.resolve_relative(F.lit("a.b.c"), F.lit(""), F.lit(2)),
        size=tx.format_bytes(F.lit(1536)), none=tx.format_bytes(F.lit(-1)), d1=tx.format_duration(F.lit(999)), d2=tx.format_duration(F.lit(12345)), d3=tx.format_duration(F.lit(245000)), d4=tx.format_duration(F.lit(7380000)),
        lines=tx.line_count(F.lit("a\nb\n")), no_lines=tx.line_count(F.lit("")), zero=tx.ratio(F.lit(1), F.lit(0)), flag=tx.parse_flag(F.lit(" ON ")), limit=tx.parse_limit(F.lit("-3")), ansi=tx.strip_ansi(F.lit("\x1b[1;31mred\x1b[0m")),
        module=tx.module_name(F.lit("a/b/c.py")),
    )
    assert r.asDict() == {
        "cut": "x" * 57 + "...", "kept": "x" * 60, "label": "renamed", "new": "untracked", "odd": "modified", "opt": "Foo", "uni": "A", "bar": "X", "lst": "List", "pascal": True, "not_pascal": False,
        "rel": "a.b.d", "up": "a", "size": "1.5 KB", "none": None, "d1": "999ms", "d2": "12.3s", "d3": "4m 5s", "d4": "2h 3m", "lines": 2, "no_lines": 0, "zero": 0.0, "flag": True, "limit": None, "ansi": "red", "module": "a.b.c",
    }


def test_search_and_pages(spark):
    df = spark.createDataFrame([(1, "LoadUser"), (2, "save_user"), (3, "other")], "id int, name string")
    assert rows(search.search(df, "USER"), "id") == [(1,), (2,)]
    assert search.search(df, "").count() == 0
    assert rows(search.search_with_total(df, "user", 1, ["id"]), "id", "total") == [(1, 2)]
    assert rows(search.after(df, "id", 1, 1, ["id"]), "id") == [(2,)]
    assert rows(search.prefix_or_all(df, "name", ["none"]), "id") == [(1,), (2,), (3,)]
    assert rows(search.prefix_or_all(df, "name", ["other"]), "id") == [(3,)]


def test_asof_takes_the_nearest_before_and_first_of_ties(spark):
    left = spark.createDataFrame([("f", 5), ("f", 10), ("f", 1), ("g", 9)], "path string, line int")
    right = spark.createDataFrame([("f", 3, 1, "a"), ("f", 10, 2, "b"), ("f", 10, 3, "c")], "path string, lineno int, ord int, name string")
    out = joins.asof(left, right, "path", "line", "lineno", {"name": "name"}, "ord")
    assert {(r["path"], r["line"]): r["name"] for r in out.collect()} == {("f", 5): "a", ("f", 10): "b", ("f", 1): None, ("g", 9): None}


def test_snapshots_and_pairs(spark):
    before = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "z")], "id string, kind string")
    after = spark.createDataFrame([("b", "y"), ("c", "q"), ("d", "x")], "id string, kind string")
    assert rows(joins.compare_snapshots(before, after, ["id"], "kind"), "id", "change", "severity") == [("a", "removed", "warning"), ("c", "changed", "warning"), ("d", "added", "info")]
    e = spark.createDataFrame([(1, "s"), (2, "x"), (3, "e"), (4, "e"), (5, "s"), (6, "s"), (7, "e")], "n int, k string").withColumn("g", F.lit(1))
    out = joins.sequence_pairs(e, ["g"], ["n"], F.col("k") == "s", F.col("k") == "e", ["n"])
    assert {(r["start_n"], r["end_n"]) for r in out.collect()} == {(1, 3), (5, None), (6, 7)}


def test_collapse(spark):
    def run(*changes):
        df = spark.createDataFrame([(i, *c) for i, c in enumerate(changes)], "seq int, event_type string, src_path string, dest_path string")
        return {r["path"]: r["event_type"] for r in events.collapse(df).collect()}

    assert run(("created", "a", None), ("modified", "a", None)) == {"a": "created"}
    assert run(("modified", "a", None), ("deleted", "a", None)) == {"a": "deleted"}
    assert run(("deleted", "a", None), ("created", "a", None)) == {"a": "created"}
    assert run(("created", "a", None), ("deleted", "a", None), ("modified", "a", None)) == {"a": "modified"}
    assert run(("moved", "a", "b"), ("modified", "b", None)) == {"a": "deleted", "b": "created"}


def test_clones_find_merge_and_score(spark):
    rng = random.Random(1)
    shared = [f"w{''.join(rng.choice('abcdef') for _ in range(6))}" for _ in range(40)]
    other = lambda n: [f"q{''.join(rng.choice('abcdef') for _ in range(8))}" for _ in range(n)]
    text = {1: other(7) + shared + other(5), 2: other(3) + shared, 3: other(30)}
    df = spark.createDataFrame([(k, " ".join(v)) for k, v in text.items()], "id int, text string")
    tok = clones.tokens(df, "text", "id")
    regions = clones.islands(clones.pairs(clones.windows(tok)), least=30)
    assert rows(regions, "file_a", "file_b", "start_a", "start_b", "token_count") == [(1, 2, 7, 3, 40)]
    sizes = spark.createDataFrame([(k, len(v)) for k, v in text.items()], "file int, total int")
    assert rows(clones.hotspots(regions, sizes), "file", "clone_count", "duplicated") == [(1, 1, 40), (2, 1, 40)]
    same = {}
    for n in ("1", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        same[n] = rows(clones.pairs(clones.windows(tok)), "file_a", "pos_a", "file_b", "pos_b")
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert same["1"] == same["8"]


@pytest.mark.parametrize("width", [1, 2, 3, 7, 10, 13])
def test_text_windows_equal_higher_order_functions(spark, width):
    rng = random.Random(width)
    rows = [(i, " ".join(rng.choice(["a", "Bc", "déf", "x1y", "zz"]) for _ in range(rng.randrange(0, 40)))) for i in range(20)] + [(98, None), (99, "")]
    df = spark.createDataFrame(rows, "id long, text string")
    want = rows_of_windows(clones.windows(clones.tokens(df.filter("text is not null"), "text", "id"), width))
    assert rows_of_windows(clones.text_windows(df, "text", "id", width)) == want


def rows_of_windows(df):
    return rows(df, "file", "pos", "hash")


def test_overlapping_windows_of_one_file_are_left_out(spark):
    df = spark.createDataFrame([(1, " ".join(["a"] * 25))], "id int, text string")
    got = rows(clones.pairs(clones.windows(clones.tokens(df, "text", "id"))), "pos_a", "pos_b")
    assert got and all(b - a >= 10 for a, b in got)


def test_covered_is_the_union(spark):
    df = spark.createDataFrame([(1, 0, 10), (1, 5, 10), (1, 5, 10), (1, 30, 5), (2, 3, 4)], "file int, start int, token_count int")
    assert rows(clones.covered(df), "file", "duplicated") == [(1, 20), (2, 4)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=30), st.lists(st.integers(0, 4), max_size=30))
def test_alignment_bounds(a, b):
    s = alignment.similarity(a, b)
    assert 0 <= s <= 1 and alignment.similarity(a, a) == (1.0 if a else 0.0)


def test_alignment_bridges_gaps():
    a = list(range(100))
    assert alignment.reach(a, 0, a[:40] + [999] + a[40:], 0, 1) == (100, 101)
    assert alignment.similarity(a, a[:40] + [999] + a[40:]) > 0.95


def test_metrics(spark):
    df = spark.createDataFrame([("f", "function", 3), ("g", "class", None), ("h", "method", 30)], "path string, kind string, c int").withColumn("loc", F.lit(10))
    r = metrics.project_metrics(df, "path", F.lit("d"), "kind", "c", "loc", ["function", "method"]).first()
    assert (r["files"], r["directories"], r["loc"], r["complexity_total"], r["complexity_max"], r["complexity_avg"]) == (3, 1, 30, 34, 30, 17)
    stage = lambda f, n, p, a: one(spark, s=metrics.stage_of(F.lit(f), F.lit(n), F.lit(p), F.lit(a)))["s"]
    assert [stage(3, 499, 0, 0), stage(3, 500, 0, 0), stage(4, 500, 0, 0), stage(21, 2999, 4, 3), stage(20, 2999, 4, 3), stage(99, 9999, 9, 9)] == [1, 1, 2, 3, 2, 3]
    s = spark.createDataFrame([("a", "skipped"), ("b", "pass"), ("b", "warn"), ("c", "error"), ("c", "pass")], "g string, s string")
    assert rows(s.groupBy("g").agg(metrics.overall_status(F.col("s")).alias("o")), "g", "o") == [("a", "skipped"), ("b", "warn"), ("c", "fail")]


def test_drift(spark):
    df = spark.createDataFrame([("info",), ("warning",), ("info",)], "severity string")
    r = drift.can_proceed(df).first()
    assert r["can_proceed"] and r["summary"] == "3 items: 0 critical, 1 warning, 2 info"
    assert drift.can_proceed(df.filter("severity = 'none'")).first()["can_proceed"]


def test_graph(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (9, 1)], "source long, target long")
    start = spark.createDataFrame([(1,)], "node long")
    assert rows(graph.reachable(edges, start, 5), "node", "depth") == [(1, 0), (2, 1), (3, 2), (4, 3)]
    assert rows(graph.reachable(edges, start, 1), "node", "depth") == [(1, 0), (2, 1)]
    walked = graph.paths(spark, edges, start, 6)
    assert rows(walked.filter("closes"), "source", "target") == [(3, 1)]
    assert rows(joins.roots(edges, "source", "target"), "node") == [(9,)]
    tree = graph.tree_nodes(spark.createDataFrame([("a/b.py",), ("a/c/d.py",)], "p string"), "p")
    assert rows(tree, "node", "parent", "is_dir") == [("a", "", True), ("a/b.py", "a", False), ("a/c", "a", True), ("a/c/d.py", "a/c", False)]


def program_rows(spark, generator, schema=None):
    df = spark.createDataFrame([p for p in PROGRAMS if schema or p[0].endswith(".py")], "path string, text string")
    return python_code.rows(df, generator, schema)


def test_python_symbols(spark):
    got = {(r["path"], r["parent"], r["name"]): (r["kind"], r["complexity"]) for r in program_rows(spark, python_code.symbols).collect()}
    assert got["app/main.py", "App", "run"] == ("method", 4)
    assert got["app/store.py", None, "load"] == ("function", 3)
    assert got["app/bad.py", None, None][0] == "error"


@pytest.mark.parametrize(
    ("code", "want"),
    [("def f(): pass", 1), ("def f(a):\n if a: pass\n elif a: pass", 3), ("def f(a, b, c): return a and b and c", 3), ("def f():\n try: pass\n except E: pass\n except G: pass", 3), ("def f(x): return [i for i in x if i]", 1), ("def f(x): return 1 if x else 2", 1), ("async def f(x):\n async for i in x:\n  while i: pass", 3)],
)
def test_complexity(code, want):
    assert [r["complexity"] for r in python_code.symbols("x.py", code)] == [want]


def test_other_symbols(spark):
    got = {(r["path"], r["parent"], r["name"], r["kind"]) for r in program_rows(spark, other_code.any_symbols, other_code.SYMBOL_SCHEMA).collect()}
    assert {("web/ui.ts", None, "Panel", "class"), ("web/ui.ts", "Panel", "draw", "method"), ("web/ui.ts", None, "run", "function"), ("web/ui.ts", None, "twice", "function")} <= got
    assert {("native/core.cpp", None, "Point", "class"), ("native/core.cpp", "Point", "norm", "method"), ("native/core.cpp", None, "Number", "class"), ("native/core.cpp", None, "add", "function")} <= got
    assert {("web/page.html", "div", "root", "element"), ("web/page.html", None, "my-card", "element"), ("web/page.html", "p", "note", "element")} <= got
    assert not any(p == "notes.txt" for p, *_ in got)


def test_tokens_normalise_and_drop_imports_comments_and_docstrings():
    python = [t["normal"] for t in other_code.tokens("x.py", 'import os\n"""doc"""\nx = f(1, "s")  # c\n', "python")]
    assert python == ["$ID", "=", "$ID", "(", "$NUM", ",", "$STR", ")"]
    c = [t["normal"] for t in other_code.tokens("x.c", '#include <a>\nint x = 1; // c\nreturn "s";', "c")]
    assert c == ["$TYPE", "$ID", "=", "$NUM", ";", "return", "$STR", ";"]


def test_call_resolution(spark):
    get = lambda g: program_rows(spark, g)
    out = resolution.resolve_calls(get(python_code.calls), get(python_code.symbols), get(python_code.imports), get(python_code.variable_types))
    got = {(r["caller"], r["receiver"], r["callee"]): (r["target"], r["status"]) for r in out.collect()}
    assert got["App.run", "self", "step"] == ("app/main.py:App.step", "resolved_project")
    assert got["main", None, "fetch"] == ("app/store.py:load", "resolved_project")
    assert got["App.run", "util", "total"] == ("app/util.py:total", "resolved_project")
    assert got["App.step", None, "print"][1] == "ignored_builtin" and got["App.step", "os", "getcwd"][1] == "ignored_stdlib"


def test_class_graph(spark):
    get = lambda g: program_rows(spark, g)
    edges = rows(resolution.class_graph(get(python_code.class_references), get(python_code.symbols), get(python_code.imports)), "source", "target", "type", "internal")
    assert ("app.main.App", "app.store.Store", "inherits", True) in edges and ("app.store.Store", "app.store.Base", "inherits", True) in edges


def test_contracts(spark):
    df = spark.createDataFrame(
        [("a", "# @contract\n# thread_safety: safe\n# @end\ndef f(): pass"), ("b", '"""Requires: x > 0."""\nraise KeyError\nraise KeyError'), ("c", "assert n > 1, 'x'"), ("d", "pass")], "k string, s string"
    )
    got = {r["k"]: (r["level"], r["thread_safety"], r["errors"]) for r in contracts.discover(df, "k", "s").collect()}
    assert got == {"a": (1, "safe", ""), "b": (2, "unknown", "KeyError"), "c": (4, "unknown", ""), "d": (5, "unknown", "")}


def test_side_by_side(spark):
    diff = "--- a\n+++ b\n@@ -10,3 +20,4 @@\n same\n-old1\n-old2\n+new1\n+new2\n+new3\n tail"
    got = rows(contracts.side_by_side(spark.createDataFrame([(1, diff)], "k int, d string"), "k", "d").fillna({"left_no": -1, "right_no": -1, "left": "", "right": ""}), "left_no", "left", "right_no", "right")
    assert got == [(-1, "", 23, "new3"), (10, "same", 20, "same"), (11, "old1", 21, "new1"), (12, "old2", 22, "new2"), (13, "tail", 24, "tail")]


def test_transcripts(spark):
    lines = ["\x1b[32mpytest -q\x1b[0m", "======", "Let me do it", "== 3 passed, 1 failed in 2.1s ==", "ValueError: bad", "git commit -m x", "Continue? [Y/n]", "plain", "FAILED a.py::b", "WARNING: old", "thinking: hm"]
    got = [(r["family"], r["type"], r["text"]) for r in transcripts.events(spark.createDataFrame([(1, "\n".join(lines))], "k int, t string"), ["k"], "t").orderBy("line_number").collect()]
    assert [g[1] for g in got] == ["test_start", "agent_planning", "test_summary", "error", "command_start", "prompt", "output", "test_result", "warning", "agent_thinking"]
    assert got[0] == ("command", "test_start", "pytest -q") and got[5][0] == "prompt"
    counts = one(spark, c=transcripts.test_counts(F.lit("3 passed, 1 failed")))["c"]
    assert (counts["passed"], counts["failed"], counts["total"]) == (3, 1, 4)
    lines = ['{"type":"system","subtype":"init","session_id":"s"}', '{"type":"assistant","message":{"content":[{"type":"text","text":"hi"}]}}', '{"type":"assistant","message":{"content":[{"type":"tool_use","name":"Bash"}]}}', "{bad", '{"type":"result","is_error":true,"result":"no"}', "{}"]
    agent = transcripts.agent_events(spark.createDataFrame(list(enumerate(lines)), "n int, t string"), ["n"], "t").orderBy("n")
    assert [(r["type"], r["content"]) for r in agent.collect()] == [("system_init", ""), ("assistant_text", "hi"), ("tool_use", "Bash"), ("parse_error", ""), ("error", "no"), ("unknown", "")]


def test_scan_snapshot_and_sinks(spark, tmp_path):
    for path, body in {"a.py": "x = 1\n", "pkg/b.PY": "y = 2\n", "node_modules/c.py": "z", ".git/d.py": "z", "e.bin": "z", "pkg/f.html": "<p>"}.items():
        (tmp_path / "src" / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "src" / path).write_text(body)
    found = files.scan(spark, str(tmp_path / "src"))
    assert rows(found, "path", "text") == [("a.py", "x = 1\n"), ("pkg/b.PY", "y = 2\n"), ("pkg/f.html", "<p>")]
    assert files.listing(files.scan(spark, str(tmp_path / "src"), with_text=False)).first().asDict() == {"files": 3, "bytes": 15}
    assert rows(files.matching(found, ["pkg/**"]), "path") == [("a.py",)]
    symbols = python_code.rows(found.filter("path = 'a.py'"), python_code.symbols).unionByName(program_rows(spark, python_code.symbols))
    files.save_snapshot(symbols, str(tmp_path / "snap"))
    again = files.load_snapshot(spark, str(tmp_path / "snap"))
    assert again.count() == symbols.count() and again.filter("complexity = 4").count() == 1
    assert files.load_snapshot(spark, str(tmp_path / "none")).count() == 0
    runs, good, bad = (spark.createDataFrame(x, "run_id int") for x in ([(1,)], [(1,), (1,)], [(1,), (2,)]))
    files.append_events(good, runs, str(tmp_path / "events"))
    with pytest.raises(LookupError):
        files.append_events(bad, runs, str(tmp_path / "events"))
    assert spark.read.parquet(str(tmp_path / "events")).count() == 2


def test_logs_status_and_tools(spark):
    log = spark.createDataFrame([(1, "h1|me|2024-05-01 10:00:00 +0200|a|b\n\nx.py\ny.py\nh2|you|2024-05-02 10:00:00 +0000|m")], "log_id int, text string")
    got = files.commits_of_log(log)
    assert rows(got, "hash", "author", "message", "files", "n_files") == [("h1", "me", "a|b", "x.py,y.py", 2), ("h2", "you", "m", "", 0)]
    assert rows(files.filter_commits(got, path="y.py"), "hash") == [("h1",)]
    status = spark.createDataFrame([(1, " M a.py\0R  new.py\0old.py\0?? u.py\0!! i.py\0")], "log_id int, text string")
    assert rows(files.status_entries(status).fillna({"rename_from": ""}), "path", "rename_from", "label", "staged", "unstaged") == [("a.py", "", "modified", False, True), ("new.py", "old.py", "renamed", True, False), ("u.py", "", "untracked", False, True)]
    many = "[" + ",".join(f'{{"filename":"f{i}","code":"E1","message":"m","location":{{"row":{i},"column":1}}}}' for i in range(30)) + "]"
    ruff = files.ruff_issues(spark.createDataFrame([(1, many), (2, "junk")], "run_id int, text string"))
    assert ruff.count() == 25 and ruff.first()["total"] == 30
    bandit = files.bandit_issues(spark.createDataFrame([(1, '{"results":[{"filename":"f","test_id":"B1","issue_text":"t","issue_severity":"HIGH","line_number":3}]}')], "run_id int, text string"))
    assert rows(bandit, "file", "severity", "line") == [("f", "high", 3)]
    said = files.text_issues(spark.createDataFrame([(1, "", "a\nb\nc\nd\ne\nf"), (2, "", "")], "run_id int, stdout string, stderr string"))
    assert rows(said, "run_id", "total", "message") == [(1, 6, "a\nb\nc\nd\ne")]
    cover = files.coverage(spark.createDataFrame([(1, '<coverage line-rate="0.8512" branch-rate="0.5"/>'), (2, "<coverage/>")], "run_id int, xml string")).orderBy("run_id").collect()
    assert (cover[0]["line_percent"], cover[0]["branch_percent"], cover[1]["line_percent"]) == (85.12, 50.0, None)


def test_settings_and_notifications(spark):
    before = spark.createDataFrame([(1, "a", None), (2, "b", 3)], "id int, root string, n int")
    after = spark.createDataFrame([(1, "a", 5), (2, "b", 3)], "id int, root string, n int")
    assert rows(files.settings_diff(before, after, "id"), "id", "changed") == [(1, "n")]
    notes = spark.createDataFrame([(1, False), (2, False)], "id int, read boolean")
    assert rows(files.mark_read(notes, 2), "id", "read") == [(1, False), (2, True)]
    kept, gone = files.clear(notes, F.col("id") == 1)
    assert rows(kept, "id") == [(2,)] and gone.first()["cleared"] == 1


def test_review_functions(spark):
    shown = one(spark, a=tx.within_root(F.lit("a/../../b")), b=tx.within_root(F.lit("a/./../b")), c=tx.within_root(F.lit("/etc")), v=tx.version_of(F.lit("tool version is 0.12.3")), n=tx.display_name(F.lit("a.b.c(d.e)")))
    assert (shown["a"], shown["b"], shown["c"], shown["v"], shown["n"]) == (False, True, False, "0.12.3", "c")
    told = lambda x, y, z=None: one(spark, s=tx.change_summary(F.lit(x), F.lit(y), F.lit(z).cast("string")))["s"]
    assert [told("M", "M"), told(" ", "D"), told("R", " ", "old.py"), told("?", "?"), told("U", "U")] == ["Modified (staged + working tree changes)", "Deleted working tree changes", "Renamed from old.py", "New file (not committed yet)", "Merge conflict in progress"]


def test_entry_points_count_calls(spark):
    from cartolith.operators import review
    from cartolith.plans.parser_queries import programs

    code = programs(spark).filter("path like '%.py'")
    found = review.entry_points(python_code.rows(code, python_code.symbols), python_code.rows(code, python_code.calls))
    counts = {(r["path"], r["parent"], r["name"]): r["node_count"] for r in found.collect()}
    assert counts["app/main.py", "App", "step"] == 4 and counts["app/main.py", None, "App"] == 1 and counts["app/util.py", None, "total"] == 0
    assert rows(review.by_class(found.filter("path = 'app/store.py'")), "owner", "names") == [("", "load"), ("Store", "open,close,put")]


def test_calls_of_other_languages(spark):
    from cartolith.operators import other_calls

    def graph(suffix, calls, symbols, resolve):
        code = spark.createDataFrame([x for x in PROGRAMS if x[0].endswith(suffix)], "path string, text string")
        return resolve(python_code.rows(code, calls, other_calls.CALL_SCHEMA), python_code.rows(code, symbols, other_code.SYMBOL_SCHEMA))

    status = lambda df: {((r["owner"] or "") + "." + r["caller"], r["callee"]): (r["status"], r["target"]) for r in df.collect()}
    script = status(graph(".ts", other_calls.script_calls, other_code.script_symbols, other_calls.resolve_script))
    assert script["Panel.draw", "run"] == ("resolved_project", "run") and script["Panel.draw", "redo"] == ("resolved_project", "Panel.redo")
    assert script["Panel.draw", "max"][0].startswith("ignored") and script["Panel.redo", "gone"] == ("unresolved", None)
    assert script["Panel.redo", "run"] == ("resolved_project", "run") and script["Panel.redo", "Panel"] == ("resolved_project", "Panel.constructor")
    assert script["Panel.redo", "log"][0] == "ignored_builtin" and script[".twice", "run"][0] == "resolved_project"
    native = status(graph(".cpp", other_calls.native_calls, other_code.native_symbols, other_calls.resolve_native))
    assert native["Box.size", "full"] == ("resolved_project", "Box::full") and native["Box.size", "add"] == ("resolved_project", "add")
    assert native["Box.full", "make"] == ("ignored_third_party", None) and native["Box.full", "max"][0] == "ignored_stdlib" and native["Box.full", "weight"] == ("unresolved", None)
    assert native["Box.make", "make"] == ("resolved_project", "Box::make") and native["Box.make", "printf"][0] == "ignored_stdlib"


def test_uml_of_classes(spark):
    code = "from typing import Optional\nimport app.store as st\nfrom lib import Thing\n\nclass A(st.Store, Thing):\n    size: int\n    def __init__(self, s):\n        self.store: Optional[Store] = None\n        self.box = Box(1)\n    def run(self, n) -> int:\n        return Helper(n)\n\nclass Box: pass\n"
    files_ = spark.createDataFrame([("app/a.py", code), ("app/store.py", "class Store: pass\n")], "path string, text string")
    model = resolution.uml_model(*(python_code.rows(files_, g) for g in (python_code.uml, python_code.symbols, python_code.imports)))
    a = {r["class"]: r for r in model.collect()}["app.a.A"]
    assert a["attributes"] == "box: Box; size: int; store: Optional[Store]" and a["methods"] == "__init__(s); run(n): int"
    assert a["edges"] == "association>Store; association>app.a.Box; inheritance>app.store.Store; inheritance>lib.Thing; instantiation>Helper"
    assert resolution.uml_stats(model).first().asDict() == {"classes": 3, "n_inheritance": 2, "n_association": 2, "n_instantiation": 1}


def test_detectors_run_by_name(spark):
    context = spark.createDataFrame([(1, "a"), (2, "b")], "n int, t string")
    detectors = {"small": lambda c: c.filter("n < 2"), "named": lambda c: c.filter("t = 'b'")}
    assert rows(drift.detected(context, detectors), "n", "detector") == [(1, "small"), (2, "named")]
    assert rows(drift.detected(context, detectors, ("named",)), "n", "detector") == [(2, "named")]
