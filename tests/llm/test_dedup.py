import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from common_cases import documents, rows_of, table

from cartolith.llm import exact_dedup, near_dedup, substring_dedup

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def low(x):
    return (x if x is not None else -(1 << 63))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_exact_decisions_match_brute_force(spark, keep):
    rows = documents(1)
    ids = defaultdict(list)
    for d, t, *_ in rows:
        ids[t or ""].append(d)
    best = {}
    for t, found in ids.items():
        real = [x for x in found if x is not None]
        best[t] = (max if keep == "largest" else min)(real) if real else None
    out = exact_dedup.decide(table(spark, rows), keep=keep)
    assert rows_of(out, "doc_id", "keep_id", "group_size", "text_sha256") == sorted([(d, best[t or ""], len(ids[t or ""]), sha(t or "")) for d, t, *_ in rows], key=repr)
    kept = rows_of(out.filter("kept"), "keep_id", "text_sha256")
    assert kept == sorted([(best[t], sha(t)) for t in ids], key=repr)
    assert all(r["doc_id"] == r["keep_id"] for r in out.filter("kept").collect())


def test_exact_normalises(spark):
    rows = [(1, "A  b", None, None), (2, "a b", None, None), (3, " a\tB ", None, None)]
    assert rows_of(exact_dedup.decide(table(spark, rows), normalise="case_space"), "keep_id", "group_size") == [(3, 3)] * 3


def test_survivors_keep_columns_and_one_row_a_group(spark):
    rows = documents(2)
    df = table(spark, rows)
    out = exact_dedup.survivors(df)
    assert out.columns == df.columns
    assert sorted((r["text"] or "") for r in out.collect()) == sorted({t or "" for _, t, *_ in rows})


def test_hot_group_spans_partitions(spark):
    rows = [(i, "the same text again", None, None) for i in range(500)] + [(1000 + i, f"other {i}", None, None) for i in range(100)]
    out = exact_dedup.decide(table(spark, rows))
    assert out.filter("group_size = 500 and keep_id = 499").count() == 500
    assert out.filter("kept").count() == 101


def shingles(text):
    words = SPACE.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def brute_components(rows):
    text = {}
    for d, t, *_ in rows:
        if d is not None:
            text[d] = t
    sets = {d: shingles(t) for d, t in text.items()}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    items = sorted(sets)
    for i, a in enumerate(items):
        for b in items[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return {d: (len(sets[d]), find(d)) for d in sets}


def test_near_components_match_brute_force(spark):
    rows = documents(3)
    want = brute_components(rows)
    out = near_dedup.near_components(table(spark, rows))
    real = out.filter("doc_id is not null")
    assert rows_of(real, "doc_id", "n_shingles", "component_id") == sorted([(d, *want[d]) for d, *_ in rows if d is not None], key=repr)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in real.collect())
    lone = out.filter("doc_id is null").collect()
    assert len(lone) == 1 and lone[0]["component_id"] is None and lone[0]["kept"]


def test_large_near_group_needs_blocks(spark, monkeypatch):
    """A base whose copies differ from it and from each other: some are linked through others, some with nothing."""
    rng = random.Random(4)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(160):
        words = list(base)
        for _ in range(rng.randrange(1, 14)):
            words[rng.randrange(150)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(words), None, None))
    monkeypatch.setattr(near_dedup, "BLOCK", 32)
    want = brute_components(rows)
    assert len({c for _, c in want.values()}) > 5
    out = near_dedup.near_components(table(spark, rows))
    assert rows_of(out, "doc_id", "component_id") == sorted(((d, want[d][1]) for d in want), key=repr)


def test_near_survivors(spark):
    rows = documents(5)
    df = table(spark, rows)
    out = near_dedup.survivors(df)
    assert out.columns == df.columns
    want = brute_components(rows)
    assert rows_of(out, "doc_id") == sorted([(d,) for d, *_ in rows if d is None or want[d][1] == d], key=repr)


def test_sketch_estimates_and_densifies():
    rng = np.random.default_rng(0)
    for n in (1, 3, 40, 3000):
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
        b = np.unique(np.concatenate([a[: max(1, n * 9 // 10)], rng.integers(0, 1 << 63, n // 10, dtype=np.uint64)]))
        s = near_dedup.registers(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
        assert (near_dedup.densified(s) != near_dedup.EMPTY).all()
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        one = near_dedup.near_pairs(s[:1], s[1:], np.array([len(a)]), np.array([len(b)]))[0]

        assert one or true < 0.75


def brute_substring(rows, width=13):
    first = {}
    words = [SPACE.findall(t or "") for _, t, *_ in rows]
    for (d, *_), w in zip(rows, words, strict=True):
        for i in range(len(w) - width + 1):
            k = tuple(w[i : i + width])
            first[k] = min(first.get(k, 1 << 62), low(d))
    out = []
    for (d, *_), w in zip(rows, words, strict=True):
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if first[tuple(w[i : i + width])] < low(d):
                gone[i : i + width] = [True] * width
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((d, len(w), sum(gone), sha(kept), kept))
    return sorted(out, key=repr)


@pytest.mark.parametrize("batches", [1, 4])
def test_substring_matches_brute_force(spark, batches):
    rows = documents(6)
    out = substring_dedup.dedup(table(spark, rows), batches=batches)
    assert rows_of(out, "doc_id", "n_words", "n_removed", "kept_sha256", "kept_text") == brute_substring(rows)


@pytest.mark.parametrize("run_bytes", [substring_dedup.RUN_BYTES, 300])
def test_index_compacts_and_goes_on(spark, monkeypatch, run_bytes):
    from pyspark.sql import functions as F

    rows = sorted((r for r in documents(7) if r[0] is not None), key=lambda r: r[0])
    monkeypatch.setattr(substring_dedup, "RUN_BYTES", run_bytes)
    index = substring_dedup.SubstringIndex(spark, buckets=8, fan=2)
    found = Counter()
    step = -(-len(rows) // 5)
    at = 0
    while at < len(rows):
        end = at + step
        while end < len(rows) and rows[end][0] == rows[end - 1][0]:
            end += 1
        part = table(spark, rows[at:end]).select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("row_hash", F.xxhash64("text"))
        for r in index.add(part).collect():
            found[r["doc_id"]] += int(np.frombuffer(r["spans"], "<u4").reshape(-1, 2)[:, 1].sum())
        at = end
    assert len(index.runs) <= 2 and (index.buckets > 8) == (run_bytes == 300)
    first, want = {}, Counter()
    for d, t, *_ in rows:
        w = SPACE.findall(t or "")
        for i in range(len(w) - 12):
            first[tuple(w[i : i + 13])] = min(d, first.get(tuple(w[i : i + 13]), 1 << 62))
    for d, t in {(d, t) for d, t, *_ in rows}:
        w = SPACE.findall(t or "")
        want[d] += sum(first[tuple(w[i : i + 13])] < d for i in range(len(w) - 12))
    assert +found == +want


def thue_morse(n, a, b):
    out = a
    while len(out) < n:
        out += "".join(b if c == a else a for c in out)
    return out[:n]


@pytest.mark.parametrize("size", [64, 128, 1024, 2048])
def test_alike_built_long_words_stay_apart(spark, size):
    """Words that polynomial hashes modulo a power of two confuse: a Thue-Morse word and its complement."""
    one, other = thue_morse(size, "a", "b"), thue_morse(size, "b", "a")
    tail = "t1 t2 t3 t4 t5 t6 t7 t8 t9 t10 t11 t12"
    rows = [(1, f"{one} {tail}", None, None), (2, f"{other} {tail}", None, None), (3, " ".join([one] * 5), None, None), (4, " ".join([other] * 5), None, None)]
    assert rows_of(substring_dedup.dedup(table(spark, rows)), "doc_id", "n_removed") == [(1, 0), (2, 0), (3, 0), (4, 0)]
    assert rows_of(near_dedup.near_components(table(spark, rows)), "doc_id", "component_id") == [(1, 1), (2, brute_components(rows)[2][1]), (3, 3), (4, 4)]


def test_rows_of_one_id_link_all_their_texts(spark):
    a, b = prose_of(1), prose_of(2)
    rows = [(1, a, None, None), (2, b, None, None), (3, a, None, None), (3, b, None, None), (4, prose_of(3), None, None), (4, prose_of(3), None, None)]
    assert rows_of(near_dedup.near_components(table(spark, rows)), "doc_id", "component_id") == [(1, 1), (2, 1), (3, 1), (3, 1), (4, 4), (4, 4)]


def prose_of(seed):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(1000)}" for _ in range(60))


def test_squeeze_round_trip():
    rng = np.random.default_rng(1)
    a = np.sort(rng.integers(0, 1 << 63, 1000, dtype=np.uint64))
    b = rng.integers(0, 1 << 16, 1000).astype(np.uint16)
    x, y = substring_dedup.unsqueeze(substring_dedup.squeeze(a, b), np.uint16)
    assert (x == a).all() and (y == b).all()
    assert len(substring_dedup.unsqueeze(substring_dedup.squeeze(a[:0]))[0]) == 0


@pytest.mark.parametrize("operator", [exact_dedup.decide, exact_dedup.survivors, near_dedup.near_components, near_dedup.survivors, substring_dedup.dedup])
def test_empty_table(spark, operator):
    assert operator(table(spark, [])).count() == 0
