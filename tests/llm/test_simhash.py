import random
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from common_cases import documents, prose, rows_of, table

from cartolith.llm import simhash as sh
from cartolith.llm import textcore as tc

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def fingerprint(text):
    words = SPACE.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    some = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] if len(words) >= 4 else ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in some]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        parent[find(a)] = find(b)
    return [find(x) for x in range(n)]


def expected(rows):
    ids = sorted({d for d, *_ in rows if d is not None})
    prints = [(d, fingerprint(t)) for d, t, *_ in rows]
    of = defaultdict(set)
    for d, p in prints:
        if d is not None:
            of[d].add(p)
    links = [(i, j) for i in range(len(ids)) for j in range(i) if any((p ^ q).bit_count() <= 4 for p in of[ids[i]] for q in of[ids[j]])]
    label = components(len(ids), links)
    least = {}
    for k, c in enumerate(label):
        least[c] = min(least.get(c, ids[k]), ids[k])
    comp = {ids[k]: least[c] for k, c in enumerate(label)}
    return sorted([(d, f"{p:016x}", comp.get(d)) for d, p in prints], key=repr)


@pytest.mark.parametrize("seed", [4, 5])
def test_components_equal_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(sh, "TILE", 8)
    rng = random.Random(seed)
    rows = documents(seed)
    for k in range(40):  # long texts that differ in a word or two have fingerprints a few bits apart
        words = prose(random.Random(seed * 100 + k % 4), 150).split()
        words[rng.randrange(len(words))] = "zzz"
        rows.append((500 + k, " ".join(words), None, None))
    assert rows_of(sh.near_components(table(spark, rows)), "doc_id", "fingerprint", "component_id") == expected(rows)


def test_whole_table_equals_brute_force(spark):
    """The query on the smallest tables, all fingerprints against all."""
    from cartolith.llm import queries

    where = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{where}/documents.parquet").collect()]
    assert rows_of(queries.op12_simhash(spark, where), "doc_id", "fingerprint", "component_id") == expected(rows)


def test_xxh64_of_all_lengths():
    rng = random.Random(1)
    raw = [bytes(rng.randrange(256) for _ in range(n)) for n in [*range(70), 200, 1000]]
    at = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
    data = np.frombuffer(b"".join(raw), np.uint8)
    for seed in (0, 42):
        assert [int(x) for x in sh.xxh64(data, at[:-1], at[1:], seed)] == [xxhash.xxh64_intdigest(x, seed) for x in raw]


def test_long_documents_and_slices_of_shingles(monkeypatch):
    monkeypatch.setattr(sh, "_SHINGLES", 50)
    texts = [prose(random.Random(k), 170 * k) for k in range(4)] + ["", "one two"]
    raw = [t.encode() for t in texts]
    at = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
    assert [int(x) for x in sh.fingerprints(np.frombuffer(b"".join(raw), np.uint8), at)] == [fingerprint(t) for t in texts]
    assert tc.string_buffers is not None


def test_forest_spans_exactly_the_links():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 2**63, 1200, dtype=np.uint64)
    for k in range(600, 1200):
        a[k] = a[rng.integers(0, k)] ^ np.uint64(1 << int(rng.integers(0, 63)))
    near = np.bitwise_count(a[:, None] ^ a[None]) <= 4
    full = components(1200, np.argwhere(np.triu(near, 1)).tolist())
    found = sh.forest(a, None, 4)
    got = components(1200, found)
    assert len(found) == 1200 - len(set(full)) and all(near[x, y] for x, y in found)
    assert len(set(zip(full, got, strict=True))) == len(set(full)) == len(set(got))
    across = sh.forest(a[:500], a[500:], 4)
    full = components(1200, [(x, y) for x, y in np.argwhere(near).tolist() if x < 500 <= y])
    assert len(across) == 1200 - len(set(full)) and all(near[x, y] for x, y in across)


def test_skipped_tiles_hold_no_link(monkeypatch):
    monkeypatch.setattr(sh, "TILE", 16)
    rng = np.random.default_rng(3)
    a = rng.integers(0, 2**64, 800, dtype=np.uint64)
    a[400:] = a[:400] ^ (np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64))
    tiles = sh.Tiles(a)
    kept = {tuple(x) for x in tiles.near(tiles, 4).tolist()}
    assert len(kept) < (800 // 16) ** 2
    for x, y in np.argwhere(np.bitwise_count(tiles.prints[:, None] ^ tiles.prints[None]) <= 4).tolist():
        assert (x // 16, y // 16) in kept


def test_hot_fingerprint_chain_and_empty_table(spark):
    rows = [(10 + k, "the very same text again and again", None, None) for k in range(3000)]
    rows += [(5000 + k, None if k % 2 else " \n", None, None) for k in range(10)]
    rows += [(7000 + k, prose(random.Random(k), 30), None, None) for k in range(200)]
    assert rows_of(sh.near_components(table(spark, rows)), "doc_id", "fingerprint", "component_id") == expected_by_print(rows)
    assert sh.near_components(table(spark, []).limit(0)).count() == 0


def expected_by_print(rows):
    """As `expected`, over distinct fingerprints, for rows with unique ids."""
    prints = [(d, fingerprint(t)) for d, t, *_ in rows]
    distinct = sorted({p for _, p in prints})
    label = components(len(distinct), [(i, j) for i in range(len(distinct)) for j in range(i) if (distinct[i] ^ distinct[j]).bit_count() <= 4])
    at = {p: label[k] for k, p in enumerate(distinct)}
    least = {}
    for d, p in prints:
        least[at[p]] = min(least.get(at[p], d), d)
    return sorted([(d, f"{p:016x}", least[at[p]]) for d, p in prints], key=repr)
