import hashlib
import math
import random
import re
import string
from collections import Counter

import numpy as np
import pytest
from common_cases import documents, prose, rows_of, table

from cartolith.llm import fingerprints, lm_scores, secrets_scan, token_counts, toxicity
from cartolith.llm.queries import tokenizer_file

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)


def base_spans(text):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out)


def secret_rows(seed=0):
    rng = random.Random(seed)
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    rows = [r for r in documents(seed)]
    for i in range(120):
        t = rng.choice([f"password={hexes(18)}", f'Token = "{hexes(40)}"', f"AKIA{''.join(rng.choice('ABCDEFGH23456') for _ in range(16))}", f"api_key: {hexes(6)}", f"key {hexes(32)}é", "secret:\n" + hexes(20), f"id {hexes(20)}"])
        rows.append((10_000 + i, f"{prose(rng, 8)} ä中 {t} {prose(rng, 8)}", "en", "s1"))
    return rows


def test_secret_scan_base_matches_brute_force(spark):
    rows = secret_rows()
    names = ("assign", "access", "hex")
    want = []
    for d, t, *_ in rows:
        found = base_spans(t or "")
        want.append((d, *(sum(k == f[1] for f in found) for k in range(3)), hashlib.sha256(",".join(f"{names[k]}:{a}:{b}" for a, k, b in found).encode()).hexdigest()))
    out = secrets_scan.scan(table(spark, rows))
    assert rows_of(out, "doc_id", "n_assign", "n_access", "n_hex", "base_sha256") == sorted(want, key=repr)
    text = {d: t for d, t, *_ in rows}
    for r in out.filter("n_model > 0").collect():
        for kind, a, b in (s.split(":") for s in r["spans"].split(",")):
            assert kind != "model" or re.fullmatch("[A-Za-z0-9+/_.=-]{16,}", text[r["doc_id"]][int(a) : int(b)])


def test_network_learns_and_keeps_recall():
    rng = random.Random(2)
    views, labels = [], []
    for i in range(600):
        good = i % 3 == 0
        body = "".join(rng.choice("0123456789abcdef") for _ in range(40)) if good else "".join(rng.choice("lmnoprstuvwxyz1") for _ in range(40))
        raw = (prose(rng, 8)[: secrets_scan.BEFORE].rjust(secrets_scan.BEFORE) + body + " " * secrets_scan.AFTER).encode()
        views.append(np.frombuffer(raw, np.uint8))
        labels.append(float(good))
    x, y = np.stack(views), np.array(labels)
    net = secrets_scan.train(x, y)
    p = secrets_scan.probabilities(net, x)
    assert (p[y > 0] >= net.threshold).mean() > 0.9 and (p[y == 0] >= net.threshold).mean() < 0.05


def test_network_finds_a_format_it_has_not_seen():
    """Trained without one format and without any trigger word, it recalls most of it, and takes few other runs."""
    rng = random.Random(6)
    syllables = ["ing", "er", "tion", "ly", "re", "an", "the", "ou"]
    words = lambda n: " ".join("".join(rng.choice(syllables) for _ in range(rng.randrange(1, 7))) + rng.choice(["", ".", ".com", "/x"]) for _ in range(n))
    known = tuple(f for f in secrets_scan.FORMATS if f != "prefixed")

    def views_of(n, formats=None):
        data, begin, _ = secrets_scan._joined(secrets_scan.pa.array([words(40) for _ in range(n)]))
        spans = secrets_scan.runs_of(data, secrets_scan.CANDIDATE, [])
        x, first = secrets_scan.views(data, spans, begin) if formats is None else secrets_scan.views(*secrets_scan.plant(data, spans, begin, formats))
        return x, first

    examples = []
    for kind, formats in ((0, None), (3, known)):
        x, first = views_of(150, formats)
        examples += [(kind, rows.tobytes()) for rows in np.split(x, first[1:])]
    net = secrets_scan.learn(examples)
    assert 0 < net.threshold < 1
    for formats, least, most in ((("prefixed",), 0.9, 1.0), (None, 0.0, 0.02)):
        assert least <= (secrets_scan.probabilities(net, *views_of(60, formats)) >= net.threshold).mean() <= most


def test_forward_pass_equals_plain_loops():
    """Embedding, convolution, maximum over all positions of all rows of a candidate, logistic output, one number at a time."""
    rng = np.random.default_rng(4)
    embed, channels, width = secrets_scan.EMBED, secrets_scan.CHANNELS, secrets_scan.WIDTH
    net = secrets_scan.Network(rng.normal(size=(128, embed)), rng.normal(size=(width * embed, channels)), rng.normal(size=channels), rng.normal(size=channels), 0.3, shift=0.2, slope=0.7)
    x = rng.integers(0, 128, (7, secrets_scan.SPAN)).astype(np.uint8)
    first = np.array([0, 1, 4])  # the second candidate has three rows, the third four
    got = secrets_scan.probabilities(net, x, first)
    for k, rows in enumerate((x[:1], x[1:4], x[4:])):
        z = net.intercept
        for c in range(channels):
            best = max(
                net.bias[c] + sum(net.embed[row[p + w]][e] * net.kernel[w * embed + e, c] for w in range(width) for e in range(embed)) for row in rows for p in range(secrets_scan.SPAN - width + 1)
            )
            z += max(best, 0) * net.out[c]
        assert abs(got[k] - 1 / (1 + np.exp(-(net.slope * z + net.shift)))) < 1e-6


def network_of(letter):
    """A network that takes a candidate if `letter` is anywhere in what it sees."""
    embed = np.zeros((128, secrets_scan.EMBED), np.float32)
    embed[ord(letter)] = 1
    return secrets_scan.Network(embed, np.ones((secrets_scan.WIDTH * secrets_scan.EMBED, secrets_scan.CHANNELS), np.float32), np.zeros(secrets_scan.CHANNELS, np.float32), np.ones(secrets_scan.CHANNELS, np.float32), -0.5, threshold=0.5)


def spans_by(spark, monkeypatch, letter, texts):
    monkeypatch.setattr(secrets_scan, "fit", lambda docs: network_of(letter))
    rows = [(i, t, None, None) for i, t in enumerate(texts)]
    return {r["doc_id"]: r["spans"] for r in secrets_scan.scan(table(spark, rows).coalesce(1)).collect()}


def test_neighbours_do_not_change_model_spans(spark, monkeypatch):
    text = "abcdefgh12345678"
    out = spans_by(spark, monkeypatch, "~", ["..", text, "..", text, "~~~~", text, "~~", text + " ~"])
    assert [out[i] for i in (1, 3, 5)] == ["", "", ""]
    assert out[7] == "model:0:16"


def test_whole_candidates_are_seen(spark, monkeypatch):
    long = "k1" * 300
    texts = [long + "Z", long + " Z", long, "Z" + long, f"{long} {',' * secrets_scan.AFTER}Z", "xx/Zpath/of/three/parts/token=abcdefghij", "ZabcdefghijklmnopQ"]
    out = spans_by(spark, monkeypatch, "Z", texts)
    assert [out[i] for i in range(5)] == ["model:0:601", "model:0:600", "", "model:0:601", ""]
    assert out[5] == "model:0:24,assign:24:40"
    assert out[6] == "model:0:18"


def test_fingerprints_match_brute_force(spark):
    rows = documents(3)
    order = sorted(rows, key=lambda r: (-(r[0] if r[0] is not None else -(1 << 63)), r[1] or ""))
    out = fingerprints.compare(table(spark, rows))
    want = []
    prints = {}
    for k, (d, t, *_) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        want.append((d, len(t), hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest()))
    assert rows_of(out, "doc_id", "n_chars", "edited_sha256") == sorted(want, key=repr)
    text = {(d, len(t or "")): t or "" for d, t, *_ in rows}
    for r in out.collect():
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        assert prints.setdefault(text[r["doc_id"], r["n_chars"]], r["fingerprint"]) == r["fingerprint"]


def plain_cuts(data: bytes):
    """The chunker byte by byte."""
    gear = fingerprints._GEAR
    out, at = [], 0
    while at < len(data):
        end = min(at + fingerprints.LARGEST, len(data))
        middle = min(at + fingerprints.NORMAL, end)
        cut = end
        for i in range(min(at + fingerprints.SMALLEST, len(data)), end + 1):
            h = 0
            for age in range(32):
                j = i - 1 - age
                h += (int(gear[data[j]]) if j >= 0 else int(gear[0])) << age
            h &= 0xFFFFFFFF
            bits = fingerprints.HARD_BITS if i <= middle else fingerprints.EASY_BITS
            if h < 1 << (32 - bits) and (i <= middle or i >= middle):
                cut = i
                break
            if i == middle and h < 1 << (32 - fingerprints.EASY_BITS):
                cut = i
                break
        out.append((at, cut))
        at = cut
    return out


def test_cuts_match_a_plain_chunker():
    rng = random.Random(5)
    texts = [prose(rng, n).encode() for n in (0, 1, 3, 50, 200)] + [b"", b"abc", "äöü中".encode() * 40]
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    starts, ends, docs = fingerprints.cuts(data, offsets)
    for d, t in enumerate(texts):
        got = [(a - offsets[d], b - offsets[d]) for a, b, x in zip(starts, ends, docs, strict=True) if x == d]
        assert got == plain_cuts(t)


def test_shift_resistance():
    rng = random.Random(6)
    text = prose(rng, 800)
    a, b = fingerprints._many([text, "inserted " + text])
    assert fingerprints.likeness(a, b) > 0.9
    assert fingerprints.likeness(*fingerprints._many([text, prose(random.Random(7), 800).upper()])) < 0.1


def plain_unigram(word, pieces):
    total = sum(1 / (k + 1) for k in range(len(pieces)))
    score = {}
    for k, p in enumerate(pieces):
        score.setdefault(p, -math.log((k + 1) * total))
    best = [(0.0, 0)] + [None] * len(word)
    for i in range(1, len(word) + 1):
        raw = len(word[i - 1].encode())
        options = [(best[i - 1][0] + token_counts.BYTE_SCORE * raw, best[i - 1][1] - raw)]
        options += [(best[j][0] + score[word[j:i]], best[j][1] - 1) for j in range(i) if word[j:i] in score]
        best[i] = max(options)
    return -best[-1][1]


def test_trie_counts_match_plain_dynamic_program():
    pieces = ["▁", "a", "b", "c", "ab", "abc", "▁ab", "bca", "caab", "é"]
    trie = token_counts.UnigramTrie(pieces)
    rng = random.Random(8)
    words = sorted({"▁" + "".join(rng.choice("abcéz中") for _ in range(rng.randrange(0, 9))) for _ in range(400)})
    want = [plain_unigram(w, pieces) for w in words]
    assert trie.walked(words) == want
    order = rng.sample(range(len(words)), len(words))
    assert trie.counts([words[k] for k in order]).tolist() == [want[k] for k in order]
    long = "▁" + "abcaab" * 100
    assert trie.counts([long, "▁", "▁ab"]).tolist() == [plain_unigram(w, pieces) for w in (long, "▁", "▁ab")]


def test_walk_of_words_that_leave_each_other_at_many_places():
    pieces = ["▁", "a", "b", "ab", "aba", "bab", "▁ab"]
    trie = token_counts.UnigramTrie(pieces)
    rng = random.Random(3)
    words = sorted({"▁" + "ab" * rng.randrange(4) + "".join(rng.choice("abz") for _ in range(rng.randrange(12))) for _ in range(300)} | {"▁"})
    assert trie.walked(words) == [plain_unigram(w, pieces) for w in words]


def test_memory_of_unbroken_text_does_not_grow_with_it():
    import tracemalloc

    trie = token_counts.UnigramTrie(["▁", "a", "b", "ab", "abba", "ba"])
    peaks = []
    for n in (20_000, 200_000):
        words = ["▁" + "abbaabz" * (n // 7), "▁" + "abbaabz" * (n // 7) + "b"]
        tracemalloc.start()
        first, second = trie.walked(words)
        peaks.append(tracemalloc.get_traced_memory()[1] / n)
        tracemalloc.stop()
        assert first <= second
    assert peaks[1] < 20  # bytes a letter; a state for each letter took hundreds


def test_token_counts_of_documents(spark):
    path = tokenizer_file("piece_bpe_32k.model")
    rows = [r for r in documents(9) if len(r[1] or "") < 2000]
    trie = token_counts.trie_of(path)
    cache = {}
    want = []
    for d, t, *_ in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        for w in words:
            if w not in cache:
                cache[w] = trie.walked(["▁" + w])[0]
        want.append((d, len(words), len(set(words)), sum(cache[w] for w in words)))
    assert rows_of(token_counts.count(table(spark, rows), path), "doc_id", "n_pretokens", "n_distinct", "n_tokens") == sorted(want, key=repr)


def test_alike_built_long_words_are_counted_apart(spark):
    """A Thue-Morse word and its complement, which polynomial hashes modulo a power of two confuse."""
    path = tokenizer_file("piece_bpe_32k.model")
    one, other = ("".join("xUab"[(bin(k).count("1") + f) % 2 * 2 + k % 2] for k in range(1024)) for f in (0, 1))
    trie = token_counts.trie_of(path)
    want = [trie.walked(["▁" + w])[0] for w in (one, other)]
    out = token_counts.count(table(spark, [(1, f"{one} {other}", None, None), (2, other, None, None)]).coalesce(1), path)
    assert rows_of(out, "doc_id", "n_distinct", "n_tokens") == [(1, 2, sum(want)), (2, 1, want[1])]


def labelled(seed=0, n=400):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        toxic = i % 4 == 0
        words = prose(rng, rng.randrange(20, 60)).split()
        if toxic:
            for _ in range(4):
                words[rng.randrange(len(words))] = "vile" + rng.choice(["st", "ness", "ly"])
        rows.append((i, " ".join(words), "en", "s1"))
        labels.append((i, int(toxic)))
    return rows, labels


def test_toxicity_on_held_out_rows(spark):
    import zlib

    rows, labels = labelled()
    df, marks = table(spark, [*rows, *documents(1)[:5], (None, None, None, None)]), spark.createDataFrame([*labels, (3, None), (None, 1)], "doc_id long, toxic int")
    out = {r["doc_id"]: r for r in toxicity.score(df, marks).collect() if r["doc_id"] is not None}
    held = [(out[d], t) for d, t in labels if zlib.crc32(str(d).encode()) % 5 == 0]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in out.values())
    assert sum(r["predicted"] == t for r, t in held) / len(held) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in out.values())
    kept = toxicity.clean(df, marks)
    assert kept.columns == df.columns
    assert kept.count() == toxicity.score(df, marks).filter("predicted = 0").count()


def test_toxicity_without_labels(spark):
    df = table(spark, documents(2))
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.score(df, none).filter("score <> 0 or predicted <> 0").count() == 0
    assert toxicity.clean(df, none).count() == df.count()
    one = spark.createDataFrame([(i, 0) for i in range(50)], "doc_id long, toxic int")
    assert toxicity.score(df, one).filter("predicted <> 0").count() == 0


def brute_kneser_ney(words, counts):
    """p(letter | context) of a class by plain recursion: own discounted counts, then continuation counts that all words share."""
    framed = [b"\x01" + w + b"\x02" for w in words]
    events = [(w[max(0, i - toxicity.ORDER + 1) : i], w[i : i + 1], n) for w, n in zip(framed, counts, strict=True) for i in range(1, len(w))]
    every = {(c[k:], x) for c, x, _ in events for k in range(len(c) + 1)}

    def lower(context, x):
        shorter = lower(context[1:], x) if context else 1 / 256
        longer = Counter(y for c, y in every if len(c) == len(context) + 1 and c[1:] == context)
        return (max(longer[x] - toxicity.DISCOUNT, 0) + toxicity.DISCOUNT * len(longer) * shorter) / longer.total() if longer else shorter

    def chance(context, x):
        own = Counter()
        for c, y, n in events:
            if c == context and n:
                own[y] += n
        backoff = lower(context[1:], x) if context else 1 / 256
        return (max(own[x] - toxicity.DISCOUNT, 0) + toxicity.DISCOUNT * len(own) * backoff) / own.total() if own else backoff

    return chance


def test_toxicity_ratios_match_brute_force():
    rng = random.Random(3)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randrange(1, 9))).encode() for _ in range(30)})
    toxic, ordinary = ([rng.randrange(0, 4) for _ in words] for _ in range(2))
    data = np.frombuffer(b" ".join(words), np.uint8)
    starts, ends, _ = toxicity.tc.word_spans(data, np.array([0, len(data)]))
    framed, at = toxicity._framed(data, starts, ends)
    where, begin = toxicity._events(framed, at)
    grams, of = np.unique(toxicity._packed(framed, begin, where + 1), return_inverse=True)
    word = np.repeat(np.arange(len(words)), np.diff(at) - 1)
    model = toxicity.Model(*toxicity.fit_ratios(grams, *(np.bincount(of, weights=np.array(c, float)[word]) for c in (toxic, ordinary))), np.array([0.0, 1.0]))
    models = [brute_kneser_ney(words, c) for c in (toxic, ordinary)]

    def ratio(w):
        f = b"\x01" + w + b"\x02"
        logs = [sum(np.log(m(f[max(0, i - toxicity.ORDER + 1) : i], f[i : i + 1])) for i in range(1, len(f))) for m in models]
        return logs[0] - logs[1]

    assert np.allclose(toxicity.word_ratios(model, data, starts, ends), [ratio(w) for w in words], atol=0.05)  # entries within 0.01 a letter of the backoff are left out
    want = np.mean([np.log(1 - toxicity.STREWN + toxicity.STREWN * np.exp(ratio(w))) for w in words])
    assert abs(toxicity.ratios(model, data, np.array([0, len(data)]))[0] - want) < 0.01


def brute_lm(rows, good):
    """(target loss, background loss) per row by counting everything anew for each document without it."""
    texts = [(t or "").translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase)) for _, t, *_ in rows]
    words = [re.findall(r"[^\x20\x09-\x0D]+", t) for t in texts]
    side = [d in good for d, *_ in rows]
    size = len({w for t in words for w in t})
    totals = [sum(len(w) for w, s in zip(words, side, strict=True) if s == k) for k in (False, True)]
    out = []
    for me, mine in enumerate(words):
        losses = []
        for k in (True, False):
            seen = [w for j, (w, s) in enumerate(zip(words, side, strict=True)) if w and (s == k or not all(totals)) and j != me]
            inside = side[me] == k or not all(totals)
            left = (totals[k] if all(totals) else sum(totals)) - (len(mine) if inside else 0)
            scale = min(1.0, (min(totals) if all(totals) else sum(totals)) / max(left, 1))
            one, pairs = Counter(w for t in seen for w in t), Counter(p for t in seen for p in zip([None, *t[:-1]], t, strict=True))
            heads = Counter()
            for (a, _), n in pairs.items():
                heads[a] += n
            p = lambda w: (scale * one[w] + lm_scores.ADD) / (scale * left + lm_scores.ADD * (size + 1))  # noqa: E731, B023
            logs = [-np.log((scale * pairs[a, w] + lm_scores.WEIGHT * p(w)) / (scale * heads[a] + lm_scores.WEIGHT)) for a, w in zip([None, *mine[:-1]], mine, strict=False)]
            losses.append(float(np.mean(logs)) if logs else 0.0)
        out.append((len(mine), *losses))
    return out


@pytest.mark.parametrize("good", [lambda rows: {d for d, *_ in rows[::3] if d is not None}, lambda rows: set()])
def test_lm_scores_match_brute_force(spark, good):
    rows = [r for r in documents(8) if r[1] is None or len(r[1]) < 2000]
    good = good(rows)
    out = lm_scores.score(table(spark, rows).repartition(7), spark.createDataFrame([(i,) for i in good], "doc_id long"))
    want = brute_lm(rows, good)
    key = lambda r: (str(r[0]), r[1], round(r[2], 6), round(r[3], 6))
    have = sorted(((r["doc_id"], r["n_tokens"], r["target_loss"], r["background_loss"]) for r in out.collect()), key=key)
    need = sorted(((d, *w) for (d, *_), w in zip(rows, want, strict=True)), key=key)
    assert [x[:2] for x in have] == [x[:2] for x in need]
    assert np.allclose([x[2:] for x in have], [x[2:] for x in need], atol=1e-9)
    assert all(abs(r["score"] - (r["background_loss"] - r["target_loss"])) < 1e-12 and (good or r["score"] == 0) for r in out.collect())


def test_lm_keeps_ids_beside_a_null_one(spark):
    """Ids above 2**53 and negative ones come back as they are, though a chunk holds a null id."""
    ids = [None, 2**60 + 1, 2**60 + 3, -(2**62) + 3, -1, 0, None, 2**63 - 1, -(2**63)]
    rows = [(i, f"some words of row {k}", None, None) for k, i in enumerate(ids)]
    out = lm_scores.score(table(spark, rows).coalesce(1), spark.createDataFrame([(2**60 + 1,)], "doc_id long"))
    assert sorted((r["doc_id"] for r in out.collect()), key=str) == sorted(ids, key=str)


def test_lm_prefers_the_target(spark):
    """Documents of the target's kind that are not in it score above others, and more distinct words than any fixed table would keep."""
    rng = random.Random(5)
    rows = [(i, " ".join(f"W{3 * min(rng.randrange(9000), rng.randrange(9000)) + i % 2}" for _ in range(300)), None, None) for i in range(60)]
    out = {r["doc_id"]: r["score"] for r in lm_scores.score(table(spark, rows), spark.createDataFrame([(i,) for i in range(0, 40, 2)], "doc_id long")).collect()}
    assert min(out[i] for i in range(40, 60, 2)) > max(out[i] for i in range(41, 60, 2))


@pytest.mark.parametrize(
    "operator",
    [
        secrets_scan.scan,
        fingerprints.compare,
        lambda df: token_counts.count(df, tokenizer_file("piece_bpe_32k.model")),
        lambda df: toxicity.score(df, df.select("doc_id", df["n"].alias("toxic"))),
        lambda df: lm_scores.score(df, df),
    ],
)
def test_empty_tables_and_awkward_rows(spark, operator):
    assert operator(table(spark, [])).count() == 0
    rows = documents(4)
    assert operator(table(spark, rows)).count() == len(rows)
