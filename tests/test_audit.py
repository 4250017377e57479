"""Audit runs and tracked work, previews, document listings, analyzers by extension and tokens of scripts."""

import datetime
import json

import pytest

from cartolith.operators import audit, review
from cartolith.sources import files, other_code


def test_runs_open_close_and_keep_notes(spark, tmp_path):
    path = str(tmp_path / "runs")
    one = audit.create_run(spark, path, "first", "/p", "n")
    two = audit.create_run(spark, path, "second")
    audit.close_run(spark, path, one)
    audit.close_run(spark, path, one, status="failed", notes="m")
    got = {r.run_id: (r.name, r.status, r.notes) for r in audit.runs(spark, path).collect()}
    assert got == {one: ("first", "failed", "m"), two: ("second", "open", None)}
    with pytest.raises(LookupError):
        audit.close_run(spark, path, one + 1)


def test_tracked_work_leaves_linked_events(spark, tmp_path):
    runs, path = str(tmp_path / "runs"), str(tmp_path / "events")
    log = audit.event_log(spark, runs, path, audit.create_run(spark, runs, "r"))

    @audit.audited("command", keep_value=True, phase="plan")
    def half(x):
        return 1 / x

    assert half(4) == 0.25  # without a log nothing is written
    assert half(2, audit=log) == 0.5
    with pytest.raises(ZeroDivisionError):
        half(0, audit=log)
    got = spark.read.parquet(path).orderBy("created_at").collect()
    assert [(r.title, r.status, r.phase, r.type) for r in got] == [
        ("half (started)", "running", "plan", "command"), ("half (completed)", "ok", "plan", "command"),
        ("half (started)", "running", "plan", "command"), ("half (failed)", "error", "plan", "command"),
    ]
    told = [json.loads(r.payload) for r in got]
    assert told[1]["start_event_id"] == got[0].event_id and told[3]["start_event_id"] == got[2].event_id
    assert told[1]["return_value"] == "0.5" and told[3]["error_type"] == "ZeroDivisionError" and told[1]["duration_ms"] >= 0
    assert got[3].detail == "Error: ZeroDivisionError: division by zero"
    with pytest.raises(LookupError):
        audit.event_log(spark, runs, path, 5)("command", "t", "ok", {})


def test_previews_tell_size_before_type(spark):
    rows = [("a/x.py", 10), ("b.yaml", 10), ("c.png", 10), ("d.png", 600_000), ("e.md", 600_000), ("Makefile", 10), (".env", 10), ("f.json", 512 * 1024)]
    got = {r.path: (r.media_type, r.preview) for r in files.previews(spark.createDataFrame(rows, "path string, size long")).collect()}
    assert got["a/x.py"] == ("text/x-python", "ok") and got["b.yaml"] == ("application/yaml", "ok") and got["Makefile"] == ("text/plain", "ok")
    assert got["c.png"] == ("image/png", "binary") and got["d.png"][1] == got["e.md"][1] == "too_large" and got["f.json"] == ("application/json", "ok")
    assert got[".env"] == ("text/plain", "ok")


def test_docs_listing(spark):
    now = datetime.datetime(2024, 1, 1)
    rows = [("docs/b/z.md", 3, now), ("docs/a.md", 1, now), ("docs/a.txt", 1, now), ("other/docs/c.md", 1, now), ("docsx/c.md", 1, now)]
    got = files.docs_listing(spark.createDataFrame(rows, "path string, size long, modified timestamp")).collect()
    assert [(r.path, r.name, r.size) for r in got] == [("docs/a.md", "a.md", 1), ("docs/b/z.md", "z.md", 3)]


def test_capabilities_leave_out_overridden_extensions(spark):
    paths = spark.createDataFrame([("a.py",), ("b.JS",), ("c.mjs",), ("d.ts",), ("e.txt",), ("f.html",)], "path string")
    got = {r.key: (r.extensions, r.available, r.degraded) for r in review.capabilities(paths, "path", ("html",), ("py", "TS")).collect()}
    assert got == {"python": (".py", True, ""), "javascript": (".js,.mjs", False, ".js,.mjs"), "html": (".html", True, "")}


def test_overrides_take_their_extension_only():
    own = lambda path, text: iter([{"path": path, "name": text}])
    run = other_code.with_overrides({"ABC": own, ".py": own})
    assert list(run("x.abc", "t")) == [{"path": "x.abc", "name": "t"}] and list(run("x.py", "t")) == [{"path": "x.py", "name": "t"}]
    assert [r["name"] for r in run("x.js", "function f() {}")] == ["f"] and list(run("abc", "t")) == []


def normal(text, language):
    return [t["normal"] for t in other_code.tokens("x", text, language)]


def test_scripts_tell_patterns_from_divisions():
    assert normal("x = a / b / c;", "javascript") == ["$ID", "=", "$ID", "/", "$ID", "/", "$ID", ";"]
    assert normal("x = /a[/]b\\/'/gi;", "javascript") == ["$ID", "=", "$STR", ";"]
    assert normal("x=/a/.test(y)", "typescript")[:3] == ["$ID", "=", "$STR"]
    assert normal("return /'/\n", "script") == ["return", "$STR"] and normal("f(a) / 2 / (b)", "script") == ["$ID", "(", "$ID", ")", "/", "$NUM", "/", "(", "$ID", ")"]
    assert normal("/x/ // c", "script") == ["$STR"] and normal("a /= 10n", "script") == ["$ID", "/=", "$NUM"]
    assert normal("", "script") == [] and normal("/", "script") == ["/"]


def test_raw_strings_end_at_their_own_mark():
    assert normal('x = R"ab(1 )" 2)ab" + 1\'000;', "cpp") == ["$ID", "=", "$STR", "+", "$NUM", ";"]
    assert normal('R"(a)" "b"', "c") == ["$STR", "$STR"]
