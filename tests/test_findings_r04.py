"""What the findings of round 4 were about."""

import random

import pyarrow as pa

from cartolith.operators import clones, modules, resolution
from cartolith.plans import module_queries
from cartolith.sources import python_code


def test_classes_are_resolved_whatever_the_order_of_rows(spark):
    """references were told apart by running numbers, which differ when rows of a shuffle come in another order."""
    texts = [(f"m{k}.py", (f"from m{k - 1} import C{k - 1} as Before\n" if k else "") + f"class C{k}({'Before' if k else 'Base'}):\n    x: Other\n") for k in range(40)]

    def shuffled(batches):
        rows = [r for b in batches for r in b.to_pylist()]
        random.SystemRandom().shuffle(rows)
        yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("path", pa.string()), ("text", pa.string())]))

    code = spark.createDataFrame(texts, "path string, text string").coalesce(1).mapInArrow(shuffled, "path string, text string")
    get = lambda g: python_code.rows(code, g)
    edges = resolution.class_graph(get(python_code.class_references), get(python_code.symbols), get(python_code.imports))
    got = sorted(map(tuple, edges.collect()))
    want = [(f"m{k}.C{k}", f"m{k - 1}.C{k - 1}" if k else "Base", "inherits", k > 0) for k in range(40)] + [(f"m{k}.C{k}", "Other", "references", False) for k in range(40)]
    assert got == sorted(want)


def chain(spark, n):
    """A module a step, each passing on the names of the one before; every fourth states a name that hides one of a star."""
    definitions = [(f"m{k}", f"f{k}", f"m{k}", f"f{k}") for k in range(n)] + [(f"m{k}", "same", f"m{k}", "same") for k in range(0, n, 4)]
    frame = lambda rows, names: spark.createDataFrame(rows, ", ".join(f"{c} string" for c in names.split()))
    stars, aliases = [(f"m{k}", f"m{k - 1}") for k in range(1, n)] + [("m0", f"m{n // 2}")], [("m5", "g", "m4", "f4"), ("m6", "f1", "m2", "f2")]
    return frame(definitions, "path name def_path def_name"), frame(aliases, "path name target target_name"), frame(stars, "path target"), definitions, aliases, stars


def test_exports_of_chains_are_one_table_and_equal_brute_force(spark, monkeypatch):
    """what was known was a union of a table a round, and each round dealt all of it out again."""
    *frames, definitions, aliases, stars = chain(spark, 12)
    known = {(p, n): (d, m) for p, n, d, m in definitions}
    stated, new = set(known) | {a[:2] for a in aliases}, dict(known)
    while new:
        found = {}
        for p, n, t, m in aliases:
            if (t, m) in new:
                found.setdefault((p, n), []).append(new[t, m])
        for p, t in stars:
            for (q, n), d in new.items():
                if q == t and (p, n) not in stated:
                    found.setdefault((p, n), []).append(d)
        new = {k: min(v) for k, v in found.items() if k not in known}
        known |= new
    want = sorted((*k, *v) for k, v in known.items())
    for few in (50_000, 0):
        monkeypatch.setattr(modules, "FEW", few, raising=False)
        got = modules.exported(*frames)
        assert sorted(map(tuple, got.collect())) == want
        assert got.rdd.getNumPartitions() <= 8


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_sources_are_parsed_once(spark, monkeypatch):
    """each use of the nodes parsed all modules again."""
    seen = []
    monkeypatch.setattr(modules, "script_exports", lambda nodes, *more, f=modules.script_exports: seen.append(nodes) or f(nodes, *more))
    module_queries.module_exports(spark, "/root/testdata/sf0.001")
    assert seen and all("MapInArrow" not in plan(n) for n in seen)


def test_calls_are_resolved_once_for_their_totals(spark, monkeypatch):
    """the totals read the calls three times, and each time resolved them."""
    seen = []
    monkeypatch.setattr(modules, "call_graph", lambda calls, f=modules.call_graph: seen.append(calls) or f(calls))
    calls = [("a", None, "f", "b", "g", "resolved_project"), ("a", "C", "m", "b", "g", "resolved_project"), ("b", None, "g", None, None, "unresolved")]
    frame = spark.createDataFrame(calls, "path string, owner string, caller string, target_path string, target string, status string")
    assert tuple(modules.graph_totals(frame.join(frame.select("path").distinct(), "path")).first()) == (2, 3, 2, 2)
    assert "Join" not in plan(seen[0])


def test_multisets_travel_by_cell(spark, monkeypatch):
    """each candidate pair carried both of its multisets through a shuffle."""
    seen = []
    monkeypatch.setattr(clones, "_bags_shared", lambda *a, f=clones._bags_shared: seen.append(a) or f(*a))
    texts = [["rare", *"abcdefghij"[: 10 - k % 2], "k" * (1 + k)] for k in range(30)]
    rows = spark.createDataFrame([(k, w) for k, ws in enumerate(texts) for w in ws], "k long, w string")
    monkeypatch.setattr(clones, "BLOCK_WORDS", 50, raising=False)
    got = clones.similar_classes(rows, "k", "w", 0.7)
    assert got.filter("n_links = 29").count() == 30 and seen == [(0.7, "bigint")]
