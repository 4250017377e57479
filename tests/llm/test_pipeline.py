import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from test_dedup import brute_components

import __spark_entry__
import corpus_pipeline
from cartolith.llm import mixing, toxicity
from cartolith.llm.queries import tokenizer_file

SMALL = "/root/testdata/sf0.001"


def test_all_operators_are_registered():
    names = set(__spark_entry__.queries())
    assert {n for n in names if n.startswith("op")} == {n for n in names if n.startswith("op") and n.split("_")[0][2:].isdigit()}
    assert {int(n.split("_")[0][2:]) for n in names if n.startswith("op")} == set(range(1, 14)) and "pipeline" in names


def test_stages_work_on_what_came_before(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    seen = [docs.count()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SMALL).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen.append(docs.count())
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
    assert seen[0] > seen[1] > seen[2] > seen[3]
    full = docs.groupBy("sequence_id").agg({"length": "sum"}).collect()
    assert all(r[1] <= 2048 for r in full)
    run = corpus_pipeline.run(spark, SMALL)
    assert sorted(map(tuple, run.drop("sequence_id", "offset").collect())) == sorted(map(tuple, docs.drop("sequence_id", "offset").collect()))


@pytest.mark.parametrize("name", ["op1", "op5", "op9"])
def test_queries_have_a_row_per_document(spark, name):
    query = next(q for n, q in __spark_entry__.queries().items() if n.startswith(f"{name}_"))
    assert query(spark, SMALL).count() == spark.read.parquet(f"{SMALL}/documents.parquet").count()


def test_run_matches_a_plain_chain(spark, tmp_path):
    """The stages' effects by plain Python: who is rejected, kept, near whom, copied how often, and packed into which pieces."""
    from tokenizers import Tokenizer

    table = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    text = {r["doc_id"]: r["text"] or "" for r in table.collect()}
    source = {r["doc_id"]: r["source"] for r in table.collect()}
    rejected = {r["doc_id"] for r in toxicity.score(table, labels).collect() if r["score"] >= 0.5}
    last = {}
    for d in sorted(set(text) - rejected):
        last[text[d]] = d
    near = brute_components([(d, t) for t, d in last.items()])
    kept = {d for d, (_, least) in near.items() if least == d}
    rows = table.filter(table["doc_id"].isin(sorted(kept)))
    taken = {r["doc_id"]: (r["taken"], r["size"]) for r in mixing.mix(rows, finest=1)["documents"].collect()}
    assert set(taken) == kept and all(n == len(re.findall(r"[^\x20\x09-\x0D]+", text[d])) for d, (_, n) in taken.items())

    out = corpus_pipeline.run(spark, SMALL).collect()
    copies = Counter(r["doc_id"] for r in out if r["piece"] == 0)
    assert set(copies) <= kept
    for d, (words, size) in taken.items():
        assert copies[d] in ({1} if not size else {int(words // size), -(-words // size)})
    whole = Tokenizer.from_file(tokenizer_file())
    whole.encode_special_tokens = True
    want = Counter()
    for d, n in copies.items():
        ids = np.array([*whole.encode(text[d], add_special_tokens=False).ids, 0], dtype="<u4")
        first = len(ids) % 2048 or 2048
        cuts = [0, *range(first, len(ids) + 1, 2048)]
        for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            want[d, k, a, b - a, zlib.crc32(ids[a:b].tobytes())] += n
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == want
    sequences = defaultdict(list)
    for r in out:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in sequences.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 2048
    assert len({source[d] for d in copies}) == len({source[d] for d in kept if taken[d][0] or not taken[d][1]})
