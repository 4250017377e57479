"""Core queries over whole tables, against brute force on the smallest tables."""

import re
from collections import Counter

import pandas as pd

from cartolith.plans.catalogue import QUERIES

DIR = "/root/testdata/sf0.001"


def pandas_table(name):
    return pd.read_parquet(f"{DIR}/{name}.parquet")


def collected(spark, name):
    return sorted(tuple(r) for r in QUERIES[name](spark, DIR).collect())


def call_walks(depth):
    """All walks from node 6, by recursion: (path, whether the last step closes a cycle)."""
    orders = pandas_table("orders").sort_values(["o_orderdate", "o_orderkey"])
    following = orders.groupby("o_orderdate")["o_custkey"].shift(-1)
    steps = {}
    for a, b in zip(orders["o_custkey"].tolist(), following.tolist(), strict=True):
        if b == b and a != b:
            steps.setdefault(a, set()).add(int(b))
    out = []

    def walk(path):
        out.append((path, False))
        for b in steps.get(path[-1], ()) if len(path) <= depth else ():
            if b in path:
                out.append(((*path, b), True))
            else:
                walk((*path, b))

    walk((6,))
    return out


def test_cycles_and_chains_over_all_calls(spark):
    walks = call_walks(5)
    closing = {}
    for path, closes in walks:
        if closes:
            closing[path[-2:]] = min(closing.get(path[-2:], 99), len(path) - 1)
    assert collected(spark, "cycle_edges") == sorted((*k, d) for k, d in closing.items())
    assert any(n % 3 for path, _ in walks for n in path)
    assert collected(spark, "call_chains") == sorted((">".join(map(str, path)), len(path) - 1) for path, closes in walks if not closes)


def test_documents_of_every_length_are_compared(spark):
    count = lambda t: Counter(re.findall("[a-z]+", (t or "").lower()))
    documents = pandas_table("documents")
    assert (documents["n_chars"] >= 1200).any()
    items = [(i, count(t)) for i, t in zip(pandas_table("benchmark")["item_id"].tolist(), pandas_table("benchmark")["text"], strict=True)]
    want = {}
    for d, text in zip(documents["doc_id"].tolist(), documents["text"], strict=True):
        a = count(text)
        for i, b in items:
            shared = sum(min(n, b[w]) for w, n in a.items() if w in b)
            if shared:
                want[d, i] = shared, shared / (a.total() + b.total() - shared)
    assert want
    got = {(r["doc_id"], r["item_id"]): (r["shared"], r["jaccard"]) for r in QUERIES["multiset_jaccard"](spark, DIR).collect()}
    assert got.keys() == want.keys()
    assert all(got[k][0] == v[0] and abs(got[k][1] - v[1]) < 1e-9 for k, v in want.items())


def test_terms_beyond_the_twelfth_are_checked(spark):
    documents, items = pandas_table("documents"), pandas_table("benchmark")
    text = dict(zip(documents["doc_id"].tolist(), documents["text"], strict=True))
    terms = [(i, t.lower().split(" ")) for i, t in zip(items["item_id"].tolist(), items["text"], strict=True) if i in text]
    want = sorted((i, term) for i, found in terms for term in found if term not in text[i])
    assert any(len(found) > 12 for _, found in terms)
    assert collected(spark, "contract_text_checks") == want


def test_edges_of_every_quantity(spark):
    lines, suppliers = pandas_table("lineitem"), pandas_table("supplier")
    lists, dates, callers = {}, {}, {}
    inside = set(suppliers["s_suppkey"][suppliers["s_acctbal"] > 0].tolist())
    for s, p, date, no in zip(lines["l_suppkey"].tolist(), lines["l_partkey"].tolist(), lines["l_shipdate"], lines["l_linenumber"].tolist(), strict=True):
        lists.setdefault(s, set()).add(p)
        dates.setdefault((s, p), set()).add(date < pd.Timestamp("1996-01-01"))
        if s in inside:
            callers.setdefault(p, []).append((s, no))
    assert collected(spark, "adjacency_list") == sorted((s, ",".join(map(str, sorted(ps))), len(ps)) for s, ps in lists.items())
    want = sorted((*k, "removed" if True in v else "added") for k, v in dates.items() if len(v) == 1)
    assert sorted((r["s"], r["t"], r["change"]) for r in QUERIES["edge_drift"](spark, DIR).collect()) == want
    assert collected(spark, "external_leaves") == sorted((p, min(v)[0], len(v), min(no for _, no in v) + 1) for p, v in callers.items())


def test_stages_count_every_file(spark):
    def most(values, bounds):
        return sum(v <= b for v, b in zip(values, bounds, strict=True))

    want = []
    for brand, g in pandas_table("part").groupby("p_brand"):
        values = len(g), g["p_size"].sum(), g["p_type"].nunique(), g["p_name"].nunique()
        want.append((brand, 1 if most(values, (3, 500, 0, 0)) >= 3 else 2 if most(values, (20, 3000, 3, 3)) >= 3 else 3))
    assert sorted((r["p_brand"], r["stage"]) for r in QUERIES["stage_decision"](spark, DIR).collect()) == sorted(want)


def test_timeline_of_the_newest_commits(spark):
    newest = pandas_table("orders").sort_values(["o_orderdate", "o_orderkey"])["o_orderkey"].tolist()[-50:]
    touched = {}
    for o, p in pandas_table("lineitem")[["l_orderkey", "l_partkey"]].itertuples(index=False):
        if o in set(newest):
            touched.setdefault(p, set()).add(o)
    assert collected(spark, "timeline_matrix") == sorted((p, len(v), "".join("01"[o in v] for o in newest)) for p, v in touched.items())
