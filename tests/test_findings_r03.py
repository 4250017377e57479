"""Queries on rows that the given tables seldom have."""

import random
import re

import duckdb
from pyspark.sql import functions as F

from cartolith.operators import clones
from cartolith.plans.catalogue import ORACLE_SQL, QUERIES


def test_words_of_lines_end_before_accented_letters(spark, tmp_path):
    texts = ["Oné de", "Tone", "errorè", "éfailed", "an exception_", "In", "thé x", "TO!", "", "what?", None]
    spark.createDataFrame([(i, 0, "user", t) for i, t in enumerate(texts)], "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = con.execute(ORACLE_SQL["transcript_line_classify"]).fetchall()
    got = QUERIES["transcript_line_classify"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_ends_of_runs_give_the_pairs_and_islands_of_all_pairs(spark):
    """Copies, edited copies, passages of too many windows inside others, null texts and ids; far fewer rows than pairs."""
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefgh", k=3)) for _ in range(200)]
    common, base = rng.choices(words, k=24), rng.choices(words, k=300)
    texts = [base, base, base[:120] + common + base[120:], base[:120] + common + base[120:], base[:150] + ["zz"] + base[150:], base[40:90] * 3, common * 4, []]
    texts += [rng.choices(words, k=20) + common + rng.choices(words, k=30) for _ in range(12)]
    rows = [(i * 7, " ".join(t)) for i, t in enumerate(texts)] + [(1, None), (None, " ".join(base))]
    for kind in ("long", "string"):
        docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("doc_id", F.col("doc_id").cast(kind)).repartition(3)
        for most in (2, 8, 500):
            pairs = clones.pairs(clones.text_windows(docs, "text", "doc_id"), most=most)
            ends = clones.run_ends(clones.window_blocks(docs, "text", "doc_id"), most=most)
            want = sorted(map(tuple, pairs.groupBy("file_a", "file_b").agg(F.count("*").alias("n")).collect()))
            assert sorted(map(tuple, clones.pair_counts(ends).collect())) == want and want
            assert sorted(map(tuple, clones.islands(ends).collect())) == sorted(map(tuple, clones.islands(pairs).collect()))
    assert ends.count() * 5 < pairs.count()


def test_pairs_of_any_similarity_are_compared(spark):
    """Groups of few keys, keys on several rows, null keys and texts."""
    a = [(1, "a b b c"), (2, "x a"), (2, "A b"), (3, None), (None, "a"), (4, "z é z"), (5, "q"), (6, "a c d e f g h i j k")]
    b = [("p", "b b b a"), ("q", "z"), ("q", "a"), ("r", ""), (None, "a")]
    left, right = spark.createDataFrame(a, "i long, text string"), spark.createDataFrame(b, "j string, text string")
    words = lambda t, k: t.select(k, F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("w"))
    want = sorted(map(tuple, clones.multiset_jaccard(words(left, "i"), words(right, "j"), "i", "j", "w").select("i", "j", "shared", "jaccard").collect()))
    for side in (2, 1024):
        assert sorted(map(tuple, clones.text_jaccard(left, right, "i", "j", "text", side).collect())) == want
    assert min(r[3] for r in want) < 0.2


def test_few_small_rows_are_written_and_parsed_by_all_tasks(spark):
    """Adaptive execution would put small tables into one task, which then parses every source."""
    from cartolith.plans import module_queries, parser_queries

    where = "/root/testdata/sf0.001"
    for made in (module_queries.scripts, module_queries.natives, module_queries.pythons, parser_queries.projects):
        found = made(spark, where).select(F.spark_partition_id().alias("p")).distinct().count()
        assert found > 1


def test_rounds_of_extension_are_few(spark, monkeypatch):
    """a walk over thousands of tokens took a round, and so a pass over all open ends, every 250 tokens."""
    from cartolith.operators import alignment

    rounds = []
    monkeypatch.setattr(alignment, "cut_lineage", lambda df, cut=alignment.cut_lineage: rounds.append(df.columns) or cut(df))
    rng = random.Random(1)
    a = [rng.randrange(5000) for _ in range(6000)]
    b = [t if k % 40 else 5000 for k, t in enumerate(a)]
    regions = spark.createDataFrame([(0, 1, 2961, 2961, 39)], "file_a long, file_b long, start_a int, start_b int, token_count int")
    tokens = spark.createDataFrame([(0, a), (1, b)], "file long, tokens array<int>")
    got = alignment.extend(regions, tokens).first()
    assert (got["start_a"], got["count_a"], got["clone_type"]) == (1, 5999, "gapped")
    assert sum("open" in c for c in rounds) <= 5


def test_hashed_tokens_of_texts(spark):
    texts = ["One two", "", None, "é a\n\nb c1d", "\nx", "İx y\n"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, text string").coalesce(1)
    want = {r[0]: [h & 0xFFFFFFFF for h in r[1] or []] for r in clones.tokens(rows, "text", "i").collect()}
    assert {r[0]: [h & 0xFFFFFFFF for h in r[1]] for r in clones.text_tokens(rows, "text", "i").collect()} == want


def shuffles(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Window"), df._jdf.queryExecution().executedPlan().toString().count("Exchange")


def test_lines_of_windows_need_no_shuffle(spark):
    """every token was a row, sorted by file twice."""
    texts = ["one\ntwo three\n\nfour", "", None, "é a\n\nb c1d e\n", "\nx y z", "a b", "a\r\nb c\n\n\nd", "x y z\n" * 700]
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, text string").coalesce(1)
    want = []
    for i, t in enumerate(texts):
        words = [(m.group(), 1 + t[: m.start()].count("\n")) for m in re.finditer("[a-z]+", t or "")]
        want += [(i, p, words[p][1], words[p + 2][1]) for p in range(len(words) - 2)]
    found = clones.text_window_lines(rows, "text", "i", 3)
    assert sorted((r["file"], r["pos"], r["start_line"], r["end_line"]) for r in found.collect()) == want
    assert sorted(map(tuple, found.select("file", "pos", "hash").collect())) == sorted(map(tuple, clones.text_windows(rows, "text", "i", 3).collect()))
    assert shuffles(QUERIES["code_window_lines"](spark, "/root/testdata/sf0.001")) == (0, 0)


def test_logs_are_parsed_within_their_rows(spark):
    """the lines of all logs were rows, sorted by a window."""
    from cartolith.sources import files

    text = "lost\nh1|a|2024-01-02 03:04:05 +0200|m|x\n f1 \n\nf2|x\n  \nh2|b|2024-02-03 00:00:00|\nh3|c|2024-01-02 03:04:06|n\nf3"
    log = spark.createDataFrame([("p", text), ("q", "no header\n"), ("r", ""), ("s", None), (None, "h|a|2024-01-01 00:00:00|c")], "log_id string, text string")
    out = files.commits_of_log(log.filter("log_id is not null"))
    got = sorted((r["log_id"], r["commit_no"], r["hash"], r["author"], str(r["date"]), r["message"], r["files"], r["n_files"]) for r in out.collect())
    assert got == [("p", 1, "h1", "a", "2024-01-02 03:04:05", "m|x", "f1,f2|x", 2), ("p", 2, "h2", "b", "2024-02-03 00:00:00", "", "", 0), ("p", 3, "h3", "c", "2024-01-02 03:04:06", "n", "f3", 1)]
    assert shuffles(out)[0] == 0


def test_multisets_are_kept_a_row_each(spark, monkeypatch):
    """every token was written as a row, and every word of every candidate pair dealt out."""
    kept = []
    monkeypatch.setattr(clones, "cut_lineage", lambda df, cut=clones.cut_lineage: kept.append(cut(df)) or kept[-1])
    monkeypatch.setattr(clones, "FREQUENT", 40)
    rng = random.Random(9)
    base = [[f"w{min(rng.randrange(60), rng.randrange(60))}" for _ in range(rng.randrange(20, 60))] for _ in range(20)]
    texts = [b[: len(b) - k] + [f"x{k}"] * k for b in base for k in (0, 1, 2)] + base[:5] + [["solo"]]
    rows = spark.createDataFrame([(k, w) for k, ws in enumerate(texts) for w in ws], "k long, w string")
    got = {r["k"]: (r["class_id"], r["n_links"], r["best_id"]) for r in clones.similar_classes(rows, "k", "w", 0.8).collect()}
    bags = [tuple(sorted(t)) for t in texts]
    first = {k: bags.index(b) for k, b in enumerate(bags)}
    found = {(r["a"], r["b"]): r["jaccard"] for r in clones.similar(rows.withColumnRenamed("k", "a"), rows.withColumnRenamed("k", "b"), "a", "b", "w", 0.8).collect()}
    near = {i: sorted((-found[i, j], j) for j in set(first.values()) if i != j and (i, j) in found) for i in set(first.values())}
    assert got == {k: (c, len(near[c]), near[c][0][1] if near[c] else None) for k, c in first.items()}
    assert sum(n for _, n, _ in got.values()) > 60 and max(f.count() for f in kept) <= len(texts)
