"""Similarity joins by prefixes and strong components, against brute force on random data."""

import random
from collections import Counter

import pytest

from cartolith.operators import clones, graph


def bags(rng, n, words):
    """Multisets of many sizes, some of them copies or near copies of others, frequent words first."""
    out = {}
    for k in range(n):
        if k and rng.random() < 0.4:
            tokens = list(out[rng.randrange(k)])
            for _ in range(rng.randrange(3)):
                tokens[rng.randrange(len(tokens))] = f"w{rng.randrange(words)}"
            if rng.random() < 0.3:
                tokens += ["w0"] * rng.randrange(4)
        else:
            tokens = [f"w{min(rng.randrange(words), rng.randrange(words))}" for _ in range(rng.randrange(1, 25))]
        out[k] = tokens
    return out


def jaccard(a, b):
    x, y = Counter(a), Counter(b)
    shared = (x & y).total()
    return shared, shared / (len(a) + len(b) - shared)


@pytest.mark.parametrize("least", [0.2, 0.5, 0.75, 0.9, 1.0])
def test_similar_equals_brute_force(spark, least):
    rng = random.Random(int(least * 100))
    a, b = bags(rng, 60, 30), bags(rng, 60, 30)
    b |= {100 + k: v for k, v in a.items() if k % 7 == 0}
    frame = lambda bag, key: spark.createDataFrame([(k, w) for k, ws in bag.items() for w in ws], f"{key} long, w string")
    got = {(r["a"], r["b"]): (r["shared"], round(r["jaccard"], 9)) for r in clones.similar(frame(a, "a"), frame(b, "b"), "a", "b", "w", least).collect()}
    want = {(i, j): (s, round(v, 9)) for i, x in a.items() for j, y in b.items() for s, v in [jaccard(x, y)] if v >= least}
    assert got == want and got


def test_prefixes_drop_candidates(spark):
    """Frequent words join few pairs: candidates are far fewer than pairs that share a word."""
    rng = random.Random(4)
    a = {k: ["the", "of", "and"] * 3 + [f"x{k}_{i}" for i in range(12)] for k in range(80)}
    a |= {200 + k: a[k][:-1] for k in range(5)}
    rows = spark.createDataFrame([(k, w) for k, ws in a.items() for w in ws], "a long, w string")
    counts = rows.groupBy("a", "w").count().withColumnRenamed("count", "n")
    seldom = counts.groupBy("w").count().withColumnRenamed("count", "seldom")
    prefix = clones._prefixes(counts, "a", "w", seldom, 0.75)
    assert prefix.filter("w in ('the', 'of', 'and')").count() == 0
    got = {(r["a"], r["b"]) for r in clones.similar(rows, rows.withColumnRenamed("a", "b"), "a", "b", "w", 0.75).collect()}
    assert got == {(i, j) for i, x in a.items() for j, y in a.items() if jaccard(x, y)[1] >= 0.75}
    assert rng is not None


def test_classes_of_copies_are_not_paired(spark):
    rng = random.Random(6)
    a = bags(rng, 40, 20)
    a |= {100 + k: rng.sample(a[k % 5], len(a[k % 5])) for k in range(60)}  # copies in other orders
    rows = spark.createDataFrame([(k, w) for k, ws in a.items() for w in ws], "k long, w string")
    bag = {k: tuple(sorted(v)) for k, v in a.items()}
    cls = {k: min(j for j in a if bag[j] == bag[k]) for k in a}
    reps = sorted(set(cls.values()))
    near = {i: [(-jaccard(a[i], a[j])[1], j) for j in reps if j != i and jaccard(a[i], a[j])[1] >= 0.6] for i in reps}
    want = {k: (cls[k], len(near[cls[k]]), min(near[cls[k]])[1] if near[cls[k]] else None) for k in a}
    got = {r["k"]: (r["class_id"], r["n_links"], r["best_id"]) for r in clones.similar_classes(rows, "k", "w", 0.6).collect()}
    assert got == want


def reach(edges, nodes):
    out = {n: {n} for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            for n in nodes:
                if a in out[n] and b not in out[n]:
                    out[n].add(b)
                    changed = True
    return out


@pytest.mark.parametrize("case", ["random", "dense", "rings", "path", "loops"])
def test_strong_components_equal_brute_force(spark, case):
    rng = random.Random(case)
    if case == "random":
        edges = {(rng.randrange(40), rng.randrange(40)) for _ in range(50)}
    elif case == "dense":
        edges = {(rng.randrange(12), rng.randrange(12)) for _ in range(60)}
    elif case == "rings":
        edges = {(10 * k + i, 10 * k + (i + 1) % 4) for k in range(4) for i in range(4)} | {(1, 11), (12, 20), (21, 31), (3, 33)}
    elif case == "path":
        edges = {(k, k + 1) for k in range(8)}
    else:
        edges = {(1, 1), (2, 2), (1, 2)}
    nodes = sorted({n for e in edges for n in e})
    far = reach(edges, nodes)
    comp = {n: min(m for m in nodes if m in far[n] and n in far[m]) for n in nodes}
    frame = spark.createDataFrame(sorted(edges), "source long, target long")
    found = graph.strong_components(frame)
    assert dict(map(tuple, found.collect())) == comp
    assert {tuple(r)[:2] for r in graph.cyclic_edges(frame, found).collect()} == {(a, b) for a, b in edges if comp[a] == comp[b]}


def test_jobs_of_strong_components_do_not_grow_with_the_length_of_rings(spark):
    """Four times as long a ring with as long a path in and out: each node a round would take about four times the jobs."""
    jobs = []
    for n in (16, 64):
        name = random.Random(n).sample(range(1000), 3 * n)
        steps = [(k, k + 1) for k in range(3 * n - 1)] + [(2 * n - 1, n)]
        frame = spark.createDataFrame([(name[a], name[b]) for a, b in steps], "source long, target long")
        spark.sparkContext.setJobGroup(f"ring {n}", "")
        found = dict(map(tuple, graph.strong_components(frame).collect()))
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"ring {n}")))
        ring = min(name[n : 2 * n])
        assert found == {v: ring if n <= k < 2 * n else v for k, v in enumerate(name)}
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[1] < 2.5 * jobs[0], jobs
