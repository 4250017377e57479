import hashlib
import random
import re

import numpy as np
import pytest
from common_cases import documents, rows_of, table
from pyspark.sql import functions as F

from cartolith.llm import fill_middle as fm
from cartolith.llm import queries

UNITS = {"char": r"(?s).", "line": r"[^\n]*\n|[^\n]+", "word": r"^[\x20\x09-\x0D]+|[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def expected(doc_id, text, unit="char", seed=1):
    text = text or ""
    digest = sha(f"{seed}:{'' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    units = re.findall(UNITS[unit], text)
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in fm.MARKERS) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    prefix, middle, suffix = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if h4 % 100 < 20:
        return doc_id, n, "spm", a, b - a, f"<S>{suffix}<P>{prefix}<M>{middle}"
    return doc_id, n, "psm", a, b - a, f"<P>{prefix}<S>{suffix}<M>{middle}"


def awkward(seed):
    rng = random.Random(seed)
    rows = documents(seed)
    for k in range(60):
        text = "".join(rng.choice(["<", "P", "S", "M", ">", "é", "中", "😀", " ", "\n", "ab"]) for _ in range(rng.randrange(0, 90)))
        rows.append((1000 + k, text, None, None))
    rows += [(2000 + k, t, None, None) for k, t in enumerate(["<P", "<P>", "x<S", "<<M>", "<M", "P>", "\n", "é"])]
    return rows


@pytest.mark.parametrize("piece", [7, 64, fm.PIECE])
@pytest.mark.parametrize("unit", sorted(UNITS))
def test_outputs_equal_brute_force(spark, monkeypatch, unit, piece):
    monkeypatch.setattr(fm, "PIECE", piece)  # small pieces cut within code points and markers
    rows = awkward(3)
    out = fm.transform(table(spark, rows), unit=unit)
    assert rows_of(out, "doc_id", "n", "form", "prefix_units", "middle_units", "output") == sorted([expected(d, t, unit) for d, t, *_ in rows], key=repr)
    back = out.select("doc_id", fm.restored(F.col("output"), F.col("form")).alias("text"))
    assert rows_of(back, "doc_id", "text") == sorted([(d, t or "") for d, t, *_ in rows], key=repr)


def test_giant_document_over_many_pieces(spark, monkeypatch):
    monkeypatch.setattr(fm, "PIECE", 1 << 10)
    text = "Größe <wörld 中文> 😀 " * 60_000
    rows = [(d, text, None, None) for d in range(6)] + [(9, text + "<M>", None, None)]
    out = fm.transform(table(spark, rows))
    assert out.filter("form <> 'plain'").count() >= 3
    got = out.select("doc_id", "n", "form", "prefix_units", "middle_units", F.sha2("output", 256).alias("h"))
    assert rows_of(got, *got.columns) == sorted([(*x[:5], sha(x[5])) for x in (expected(d, t) for d, t, *_ in rows)], key=repr)


def test_query_digests_rates_and_empty_table(spark, tmp_path):
    rows = [(k, f"text number {k} " * 3, None, None) for k in range(2000)]
    table(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    out = queries.op13_fill_middle(spark, str(tmp_path))
    forms = dict(rows_of(out.groupBy("form").count(), "form", "count"))
    assert 0.07 < forms["plain"] / 2000 < 0.13 and 0.17 < forms["spm"] / (forms["spm"] + forms["psm"]) < 0.23
    assert rows_of(out, "doc_id", "restored_sha256") == sorted([(d, sha(t)) for d, t, *_ in rows], key=repr)
    assert fm.transform(table(spark, []).limit(0)).count() == 0


def test_other_markers_and_rates(spark):
    rows = [(k, f"some text {k}", None, None) for k in range(50)]
    marks = ("<|pre|>", "<|suf|>", "<|mid|>")
    out = fm.transform(table(spark, rows), markers=marks, rate=100, suffix_first=100)
    assert {r["form"] for r in out.collect()} == {"spm"}
    back = out.select("doc_id", fm.restored(F.col("output"), F.col("form"), marks).alias("text"))
    assert rows_of(back, "doc_id", "text") == sorted([(d, t) for d, t, *_ in rows], key=repr)
    for wrong in (("<P>", "<P>", "<M>"), ("aba", "x", "y"), ("ab", "bc", "z"), ("", "x", "y")):
        with pytest.raises(ValueError):
            fm.transform(table(spark, rows), markers=wrong)


def test_composition_is_associative():
    rng = np.random.default_rng(0)
    machine = fm.automaton("word", fm.MARKERS)
    raw = "ab <P <S>x\n <M".encode() * 9
    data = np.frombuffer(raw, np.uint8)
    for _ in range(50):
        cuts = np.sort(rng.integers(0, len(raw) + 1, 2))
        bounds = np.array([0, *cuts, len(raw)])
        moves, counts = machine.functions(data, bounds)
        f = [(moves[k : k + 1], counts[k : k + 1]) for k in range(3)]
        left = fm.composed(*fm.composed(*f[0], *f[1]), *f[2])
        right = fm.composed(*f[0], *fm.composed(*f[1], *f[2]))
        whole = machine.functions(data, np.array([0, len(raw)]))
        for x, y, z in zip(left, right, whole, strict=True):
            assert (x == y).all() and (x == z).all()
