"""Documents with every awkward case, and a way to make them a table with clashing extra columns."""

import random

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", ",", "."]) for _ in range(n))


def documents(seed: int = 0) -> list[tuple]:
    """(doc_id, text, lang, source): copies, near copies, shared passages, nulls, empties, a very long text, ties."""
    rng = random.Random(seed)
    passage = prose(rng, 40)
    base = prose(rng, 120).split()
    texts = [prose(rng, rng.randrange(1, 60)) for _ in range(24)]
    texts += [texts[0], texts[0], texts[1].upper()]
    for _ in range(8):
        words = list(base)
        for _ in range(rng.randrange(1, 9)):
            words[rng.randrange(len(words))] = rng.choice(WORDS) + "x"
        texts.append(" ".join(words))
    texts += [f"{prose(rng, 9)} {passage} {prose(rng, 9)}" for _ in range(5)]
    texts += ["", None, "   \t\n ", "one", "One", "Übergröße 中文   wide space", "a b c d", "a b c d e", prose(rng, 4000), "line\n" * 300]
    rows = [(i * 3 + 5, t, rng.choice(["en", None]), rng.choice(["s1", "s1", "s1", "s2", "s3", None])) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (rows[4][0], rows[4][1], "en", "s2"), (None, "a row without an id", None, "s1"), (-7, "a negative id here", "en", "s2")]
    rng.shuffle(rows)
    return rows


#: Names that the operators use inside.
EXTRA = ("key", "n", "rank", "part", "size", "src", "score", "label", "bucket", "kept", "run", "keep", "target", "block", "spans", "comp")


def table(spark, rows):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return df.withColumns({name: F.lit(7) for name in EXTRA})


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.select(*columns).collect()), key=repr)
