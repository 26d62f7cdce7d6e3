"""Small corpora with the awkward cases every operator has to stand."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = ", size int, score string, taken string, shard string, digest string, n_tokens string, a int, `my col.x` string"


def awkward(seed=1, n=60):
    """Rows with NULLs in every column, empty, blank and very long texts, ties, copies and repeated rows."""
    rng = random.Random(seed)
    words = ["alpha", "Beta", "gamma", "idiot", "über", "naïve", "x", "the", "of", "and", "I'm", "42", "　", "déjà"]
    rows = []
    for i in range(n):
        text = " ".join(rng.choice(words) for _ in range(rng.randrange(1, 40)))
        if rng.random() < 0.3:
            text = text.replace(" ", "\n", 5)
        rows.append((i, text, rng.choice(["en", None]), rng.choice(["s1", "s2", "s3", None]), len(text)))
    long = " ".join(rng.choice(words) for _ in range(30_000))
    rows += [(n, None, None, None, None), (n + 1, "", "en", "s1", 0), (n + 2, " \n\t ", "en", "s2", 4), (n + 3, long, "en", "s1", len(long)),
             (n + 4, rows[3][1], "en", "s9", 5), (n + 5, rows[3][1], "en", "s1", 5), (None, "no key here", "en", "s1", 11), (None, None, None, None, None),
             (7, rows[7][1], rows[7][2], rows[7][3], rows[7][4]), (7, rows[7][1], rows[7][2], rows[7][3], rows[7][4])]
    return rows


def frame(spark, rows, extra=False):
    if extra:
        return spark.createDataFrame([(*r, 1, "s", "t", "u", "v", "w", 2, "y") for r in rows], SCHEMA + EXTRA)
    return spark.createDataFrame(rows, SCHEMA)


def table(df, *columns):
    """Rows as sorted tuples; NULL first."""
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=lambda r: tuple((x is not None, x) if x is not None else (False, 0) for x in r))


def multiset(rows):
    return sorted(map(repr, rows))
