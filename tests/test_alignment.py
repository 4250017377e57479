"""Extension of regions over slices, against the same walk over whole files."""

import random

import pytest

from cartolith.operators import alignment


def walk(a, i, b, j, step):
    """The extension over whole sequences, written out on its own."""
    start, last = (i, j), (i, j)
    inside = lambda x, s: 0 <= x < len(s)
    while inside(i, a) and inside(j, b):
        if a[i] == b[j]:
            i, j = i + step, j + step
            last = (i, j)
            continue
        found = None
        for total in range(1, alignment.LOOKAHEAD + 1):
            for da in range(total + 1):
                x, y = i + da * step, j + (total - da) * step
                if da <= alignment.GAP and total - da <= alignment.GAP and inside(x, a) and inside(y, b) and a[x] == b[y]:
                    found = found or (x, y)
        if found is None:
            break
        i, j = found
    return abs(last[0] - start[0]), abs(last[1] - start[1])


def whole(fa, fb, sa, sb, n, a, b):
    back, ahead = walk(a, sa - 1, b, sb - 1, -1), walk(a, sa + n, b, sb + n, 1)
    x, y, na, nb = sa - back[0], sb - back[1], n + back[0] + ahead[0], n + back[1] + ahead[1]
    alike = alignment.similarity(a[x : x + na], b[y : y + nb])
    if (na > n or nb > n) and alike >= alignment.THRESHOLD:
        return fa, fb, x, y, na, nb, round(alike, 9), "gapped"
    return fa, fb, sa, sb, n, n, 1.0, "exact"


def edited(rng, tokens, share):
    out = []
    for t in tokens:
        if rng.random() < share:
            out += rng.choice([[], [t, rng.randrange(1000)], [rng.randrange(1000)]])
        else:
            out.append(t)
    return out


@pytest.mark.parametrize(("block", "size"), [(8, 16), (256, 256)])
def test_slices_give_what_whole_files_give(spark, monkeypatch, block, size):
    monkeypatch.setattr(alignment, "BLOCK", block)
    rng = random.Random(size)
    base = [rng.randrange(60) for _ in range(900)]
    files = {0: base, 1: edited(rng, base, 0.03), 2: edited(rng, base[200:700], 0.1), 3: [rng.randrange(60) for _ in range(400)], 4: base[:300] + [1, 2, 3], 5: base[300:310], 6: []}
    regions = []
    for fa in files:
        for fb in files:
            a, b = files[fa], files[fb]
            if fa < fb:
                for i in rng.sample(range(len(a)), min(len(a), 40)):
                    for j in [j for j in range(len(b)) if b[j : j + 2] == a[i : i + 2] != []][:3]:
                        n = 0
                        while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                            n += 1
                        regions.append((fa, fb, i, j, n))
    regions = sorted(set(regions) | {(0, 1, 0, 0, 0)})
    assert len(regions) > 30
    want = sorted(whole(*r, files[r[0]], files[r[1]]) for r in regions)
    frame = spark.createDataFrame(regions, "file_a long, file_b long, start_a int, start_b int, token_count int")
    tokens = spark.createDataFrame(list(files.items()), "file long, tokens array<int>")
    got = sorted((*tuple(r)[:6], round(r["similarity"], 9), r["clone_type"]) for r in alignment.extend(frame, tokens).collect())
    assert got == want
    assert {r[-1] for r in got} == {"gapped", "exact"} and max(r[4] for r in got) > alignment.SLICE


def test_query_equals_whole_documents(spark):
    """Every region of the smallest tables, compared over whole documents."""
    from cartolith.operators import clones
    from cartolith.plans.catalogue import QUERIES

    where = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{where}/documents.parquet")
    files = {r["file"]: r["tokens"] for r in clones.tokens(docs, "text", "doc_id").collect()}
    regions = clones.islands(clones.pairs(clones.text_windows(docs, "text", "doc_id")), least=clones.MIN_TOKENS).select("file_a", "file_b", "start_a", "start_b", "token_count").collect()
    want = sorted(whole(*r, files[r[0]], files[r[1]]) for r in map(tuple, regions))
    got = sorted((*tuple(r)[:6], round(r["similarity"], 9), r["clone_type"]) for r in QUERIES["alignment_similarity"](spark, where).collect())
    assert got == want and got
