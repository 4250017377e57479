"""The block grammar, strategies of languages, rewriting and previews."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cartolith.operators import contract_blocks as cb

WHOLE = {
    "thread_safety": "safe", "lifecycle": "init: then", "invariants": [], "preconditions": ["n > 0", "a: b", "- x", "it's", "[x", "# no"], "postconditions": [], "errors": ["E"], "dependencies": [],
    "evidence": [{"type": "test", "reference": "t.py::x", "policy": "required"}, {"type": "lint", "reference": "ruff", "policy": "optional"}],
}


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("a: 1\nb: x y # said\nc: true\nd: ~\ne:\nf: 1.5", {"a": 1, "b": "x y", "c": True, "d": None, "e": None, "f": 1.5}),
        ("a:\n  - x\n  - b: 2\n    c: [1, 'q, r', {k: v, l: [m]}]\n  -\n    - p\n  - - q\n    - r", {"a": ["x", {"b": 2, "c": [1, "q, r", {"k": "v", "l": ["m"]}]}, ["p"], ["q", "r"]]}),
        ("a:\n- s\n- t\nb: {}\nc: []", {"a": ["s", "t"], "b": {}, "c": []}),
        ("a:\n    b:\n        c: d\n    e: f\n", {"a": {"b": {"c": "d"}, "e": "f"}}),
        ("'k: x': \"a\\nb\"\nl: 'it''s'", {"k: x": "a\nb", "l": "it's"}),
        ("# only\n\nx: t.py::f", {"x": "t.py::f"}),
        ("- a\n- b", ["a", "b"]), ("plain", "plain"), ("", None),
    ],
)
def test_blocks_are_read(text, want):
    assert cb.read_block(text) == want


@pytest.mark.parametrize("text", ["a: [1, 2", "a: 'x", "a: {b: 1", "a: {b}", "a: 1\n   b: 2", "a\nb: 1", "- a\nb: 1", "a: b: c", "a: 1\n  - x", "\ta: 1", "a: [x] y", "a: @b", "a:\n    - x\n  - y"])
def test_broken_blocks_have_no_confidence(text):
    with pytest.raises(ValueError):
        cb.read_block(text)
    got = cb.contract_of(text)
    assert got["confidence"] == 0.0 and got["note"].startswith("invalid") and got["thread_safety"] == "unknown"


def test_fields_of_blocks():
    assert cb.contract_of("")["note"] == cb.contract_of("- x")["note"] == "empty or no map"
    got = cb.contract_of("thread_safety: maybe\nerrors: one\nevidence:\n  - test: a\n    policy: never\n  - lint: b\n    policy: warning\n  - x\n  - typecheck:\n")
    assert (got["thread_safety"], got["errors"], got["evidence"], got["confidence"]) == ("unknown", ["one"], [{"type": "lint", "reference": "b", "policy": "warning"}], 1.0)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab:#-'\"[]{},& 1~\\"), min_size=1).map(str.strip).filter(bool), max_size=4), st.sampled_from(cb.THREADS))
def test_written_blocks_read_back(values, threads):
    contract = {"thread_safety": threads, "lifecycle": values[0] if values else None, "preconditions": values, "errors": values[::-1], "evidence": [{"type": "lint", "reference": v, "policy": "warning"} for v in values]}
    got = cb.contract_of("\n".join(cb.block_lines(contract)))
    assert {k: got[k] for k in contract} == contract and got["confidence"] == 1.0


PYTHON = "class A:\n    def f(self, n):\n        return n\n\ndef g():\n    '''One line.'''\n    return 1\n\ndef h(\n    a,\n):\n    \"\"\"Head.\n\n    Args:\n        a: must be positive. Yes.\n    Raises:\n        ValueError: no\n    Note:\n        Not thread-safe.\n    \"\"\"\n    return a\n"
NATIVE = "#include <a>\n/** Adds.\n * @pre n > 0\n * @post sum\n * @invariant x\n * @throws std::bad when\n *   out of it\n * @note thread-safe */\n  int add(int n);\n// plain words\n\nint k();\nstruct S;\n"


@pytest.mark.parametrize(("path", "text", "line"), [("a.py", PYTHON, 2), ("a.py", PYTHON, 5), ("a.py", PYTHON, 9), ("b.cpp", NATIVE, 9), ("b.h", NATIVE, 12), ("c.ts", NATIVE, 13), ("d.tsx", "f();", 1)])
def test_contracts_are_written_updated_and_removed(path, text, line):
    s = cb.strategy_of(path)
    written = s.written(text, line, WHOLE)
    at = line if path.endswith("py") else line + written.count("\n") - text.count("\n")
    got = s.read(written, at)
    assert {k: got[k] for k in WHOLE} == WHOLE and got["level"] == 1
    assert s.written(written, at, WHOLE) == written
    shorter = s.written(written, at, {"thread_safety": "unknown"})
    at2 = at if path.endswith("py") else at - (written.count("\n") - shorter.count("\n"))
    assert s.read(shorter, at2)["preconditions"] == [] and s.read(shorter, at2)["confidence"] == 1.0
    words = lambda t: t.replace('"""', " ").replace("'''", " ").split()
    assert words(s.removed(shorter, at2)) == words(text)
    other = [n for n in (2, 5, 9) if n != line] if path == "a.py" else []
    for n in other:  # what is written for one symbol is not another's
        moved = n + (written.count("\n") - text.count("\n") if n > line else 0)
        assert s.read(written, moved)["level"] != 1


def test_documentation_is_read():
    got = cb.strategy_of("a.py").read(PYTHON, 9)
    assert (got["level"], got["preconditions"], got["errors"], got["thread_safety"]) == (2, ["input must be positive"], ["ValueError: no"], "not_safe")
    got = cb.strategy_of("b.cpp").read(NATIVE, 9)
    assert (got["preconditions"], got["postconditions"], got["invariants"], got["thread_safety"]) == (["n > 0"], ["sum"], ["x"], "safe")
    assert got["errors"] == ["std::bad: when out of it"] and got["confidence"] == 0.8
    assert cb.strategy_of("b.cpp").read(NATIVE, 12)["level"] == 5 and cb.strategy_of("x.txt") is None


def test_own_strategies_and_previews(spark):
    class Hashed(cb.TaggedComments):
        prefix = "# "

    rows = spark.createDataFrame([(1, "a.rb", "def f\nend\n", 1), (2, "a.txt", "x", 1), (3, "a.py", PYTHON, 5), (4, "a.py", None, 1)], "id long, path string, text string, line int")
    from pyspark.sql import functions as F

    with_contract = rows.filter("id < 4").withColumn("contract", F.struct(F.lit("safe").alias("thread_safety"), F.array(F.lit("p")).alias("preconditions")))
    own = {"rb": Hashed()}
    out = {r["id"]: r["rewritten"] for r in cb.rewrite(with_contract, "contract", own=own).collect()}
    assert out[1] == "# @contract-begin\n# thread_safety: safe\n# preconditions:\n#   - p\n# @contract-end\ndef f\nend\n" and out[2] == "x"
    levels = {r["id"]: r["level"] for r in cb.read(rows, own=own).collect()}
    assert levels == {1: 5, 2: 5, 3: 5, 4: 5}
    hunks = cb.preview(cb.rewrite(with_contract, "contract", own=own), ["id"]).collect()
    assert {r["id"] for r in hunks} == {1, 3} and all("+" in r["body"] for r in hunks)
