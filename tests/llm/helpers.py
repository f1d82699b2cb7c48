"""Small documents with everything that may go wrong in them."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, row long, mark long, doc string, ids string"


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(["Tha", "er", "on", "ti", "the", "and", "en"]) + rng.choice(["re", "st", "ing", "ou"]) * rng.randint(0, 2) for _ in range(n))


LONG = prose(99, 20_000)
TEXTS = [
    (1, prose(1, 60)), (2, prose(1, 60)), (3, prose(1, 59) + " changed"), (4, prose(4, 80) + "\nShared line of words " + "x " * 9),
    (5, None), (6, ""), (7, " \n\t\n "), (8, "é" * 40 + " ñandú 漢字 \U0001f600"), (9, LONG), (10, LONG), (11, "one"), (12, "One."),
    (None, prose(12, 30)), (None, None), (13, prose(13, 30)), (13, prose(13, 30)), (13, prose(14, 30)), (14, "1234 !!! ???"),
]


def documents(spark, texts=None):
    rows = [(i, t, "en" if i is None or i % 2 else None, "s", len(t or ""), "k", 1, 2, "d", "i") for i, t in (TEXTS if texts is None else texts)]
    return spark.createDataFrame(rows, SCHEMA)


def plain(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)
