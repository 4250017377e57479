import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from common_cases import documents, rows_of, table

from cartolith.llm import spelling as sp
from cartolith.llm.common import Scratch, skewed_join

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def count(rows):
    found = Counter()
    for d, text, *_ in rows:
        for run in RUN.findall(text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= 5 and n >= 3}


def near_sets(words):
    """Pairs by wildcards: words with one code point replaced by a mark, and words less one code point."""
    holes, shorter = defaultdict(set), defaultdict(set)
    for w in words:
        for p in range(len(w)):
            holes[w[:p] + "\0" + w[p + 1 :]].add(w)
            shorter[w[:p] + w[p + 1 :]].add(w)
    near = defaultdict(set)
    for group in holes.values():
        for a in group:
            near[a] |= group - {a}
    for w, longer in shorter.items():
        if w in words:
            near[w] |= longer
            for u in longer:
                near[u].add(w)
    return near


def expected(words):
    near, form, out = near_sets(words), {}, []
    for w in words:
        best = min(near[w], key=lambda u: (-words[u], u), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), None if form[w] is None else words[form[w]]))
    return sorted(out, key=repr)


COLUMNS = "word", "form", "root", "n", "n_near", "form_n"


def noisy(seed, docs=300):
    rng = random.Random(seed)
    stems = ["".join(rng.choice("abcdeé") for _ in range(rng.randrange(4, 11))) for _ in range(60)] + ["aaaaa", "aaaaaa", "aaaaaaa", "ab" * 300, "ab" * 300 + "a"]
    rows = documents(seed)
    for k in range(docs):
        words = []
        for _ in range(40):
            w = rng.choice(stems[: rng.randrange(1, len(stems))])
            if rng.random() < 0.3:
                p = rng.randrange(len(w))
                w = rng.choice([w[:p] + w[p + 1 :], w[:p] + rng.choice("abcÀÿ") + w[p:], w[:p] + rng.choice("xyz") + w[p + 1 :]])
            words.append(w.upper() if rng.random() < 0.1 else w)
        rows.append((9000 + k, rng.choice([" ", "-", "中", "1"]).join(words), None, None))
    return rows


@pytest.mark.parametrize("block", [5, 1 << 16])
def test_variants_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(sp, "BLOCK", block)
    rows = noisy(block)
    words = count(rows)
    assert len(words) > 400
    assert rows_of(sp.variants(table(spark, rows)), *COLUMNS) == expected(words)


def test_query_on_whole_table_equals_brute_force(spark):
    from cartolith.llm import queries

    where = "/root/testdata/sf0.01"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{where}/documents.parquet").collect()]
    assert rows_of(queries.op11_spelling_variants(spark, where), *COLUMNS) == expected(count(rows))


def test_search_in_small_batches_and_steps(monkeypatch):
    """One cell of first halves after another, in batches that end within cells."""
    monkeypatch.setattr(sp, "GATHER", 40)
    monkeypatch.setattr(sp, "AT_ONCE", 30)
    rng = random.Random(9)
    words = {"".join(rng.choice("abc") for _ in range(rng.randrange(5, 8))): rng.randrange(3, 9) for _ in range(400)}
    rows = []
    for w, n in words.items():
        for length in (len(w), len(w) - 1):
            half = length // 2
            rows += [(length, front, w[:half] if front else w[len(w) - (length - half) :], 0, 0, w, n, True, len(w) == length) for front in (False, True)]
    rows.sort(key=lambda r: r[:5])
    types = pa.schema([(c, t) for c, t in zip("lshxywnfa", [pa.int32(), pa.bool_(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.bool_(), pa.bool_()], strict=True)])
    batches = [pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows[k : k + 17], strict=True), types, strict=True)], schema=types) for k in range(0, len(rows), 17)]
    found = defaultdict(int)
    for batch in sp._searched(iter(batches)):
        for row in batch.to_pylist():
            found[row["word"]] += row["n_near"]
    assert found == {w: len(s) for w, s in near_sets(words).items() if s}


def test_roots_follow_long_chains(spark):
    # Each word is near the next and half as frequent, 12 steps to the last.
    word = "abcdefghij"
    chain = [word]
    for k in range(12):
        word = word[: k % 10] + chr(ord("k") + k) + word[k % 10 + 1 :]
        chain.append(word)
    rows = [(None, " ".join([w] * (3 * 2**k)), None, None) for k, w in enumerate(chain)]
    words = count(rows)
    got = rows_of(sp.variants(table(spark, rows)), *COLUMNS)
    assert got == expected(words)
    assert len({r[2] for r in got}) < len(got)


def test_one_long_text_is_cut_between_runs(monkeypatch):
    rng = random.Random(2)
    text = " ".join("".join(rng.choice("abÀÿ") for _ in range(rng.randrange(1, 9))) for _ in range(4000)) + "x" * 9000 + " tail tail"
    data = np.frombuffer(text.encode(), np.uint8)
    for most in (50, 1000):
        cuts = sp._cuts(data, most)
        assert cuts[0] == 0 and cuts[-1] == len(data) and cuts == sorted(cuts) and len(cuts) > 4
        parts = [r for a, b in zip(cuts[:-1], cuts[1:], strict=True) for r in RUN.findall(data[a:b].tobytes().decode())]
        assert parts == RUN.findall(text)


def test_crc32_of_all_lengths():
    rng = random.Random(3)
    raw = [bytes(rng.randrange(256) for _ in range(n)) for n in [*range(40), 255, 256, 257, 900]]
    at = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
    before = np.array([zlib.crc32(f"{k}:".encode()) for k in range(len(raw))], dtype=np.uint32)
    assert sp.crc32(np.frombuffer(b"".join(raw), np.uint8), at[:-1], at[1:], before).tolist() == [zlib.crc32(x, int(c)) for x, c in zip(raw, before, strict=True)]


def test_wavelet_tree_reports_rectangles():
    rng = np.random.default_rng(4)
    for n in (1, 2, 7, 64, 300):
        values = rng.permutation(n)
        left, low = rng.integers(0, n, 50), rng.integers(0, n, 50)
        right, high = left + rng.integers(0, n, 50), low + rng.integers(0, n, 50)
        right, high = np.minimum(right, n), np.minimum(high, n)
        query, value = sp.WaveletTree(values).report(left, right, low, high)
        want = sorted((q, int(v)) for q in range(50) for v in values[left[q] : right[q]] if low[q] <= v < high[q])
        assert sorted(zip(query.tolist(), value.tolist(), strict=True)) == want


def test_letters_beyond_latin_in_word_tables(spark):
    words = {"слово": 9, "слова": 3, "словах": 1, "wörter": 2, "wörtern": 5, "a": 1, "ab": 7, "b": 2}
    near = sp.near_words(spark.createDataFrame(list(words.items()), "word string, n long"), Scratch(spark, "t"))
    sets = near_sets(words)
    want = [(w, len(s), *min((-words[u], u) for u in s)) for w, s in sets.items() if s]
    assert rows_of(near, "word", "n_near", "best_n", "best") == sorted([(w, c, -m, u) for w, c, m, u in want], key=repr)


def test_skewed_join_is_an_outer_join(spark):
    left = spark.createDataFrame([(1, k) for k in range(3000)] + [(k, 0) for k in range(2, 40)], "k long, v long")
    right = spark.createDataFrame([(1, 3000, "hot"), *((k, 1, f"r{k}") for k in range(2, 30))], "k long, w long, t string")
    got = skewed_join(left, right, ["k"], "w", 3038)
    want = left.join(right, "k", "left")
    assert rows_of(got, "k", "v", "w", "t") == rows_of(want, "k", "v", "w", "t")


def test_empty_table(spark):
    assert sp.variants(table(spark, []).limit(0)).count() == 0
    assert sp.variants(table(spark, [(1, None, None, None), (2, "", None, None)])).count() == 0
