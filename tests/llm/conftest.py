import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _key_id string, fp string, keep string, row string, a string, vec string"


def documents(spark, rows):
    """rows: (doc_id, text[, lang]); the extra columns have names that operators use inside."""
    return spark.createDataFrame([(r[0], r[1], r[2] if len(r) > 2 else "en", "s", 0, "x", "y", "z", "w", "v", "u") for r in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def edge_rows():
    """Null and empty texts, blanks, repeated rows, one id with two texts, null ids, a very long text, near copies."""
    rng = random.Random(5)
    words = ["the", "of", "Ähre", "été", "x1", "and", "tie", "loop", "señor", "日本"]
    body = lambda n: " ".join(rng.choices(words, k=n))
    first, long = body(80), " ".join(f"w{i % 7919}" for i in range(40_000))
    rows = [(1, None), (2, ""), (3, " \n \t"), (4, first), (5, first), (5, first), (6, first + " tail"), (7, "line\nLine \nother"), (7, "another text of the same id"), (None, first), (None, None), (8, long), (9, long), (10, "a"), (11, "\n\n"), (12, "one\x0btwo\r\nthree"), (13, "héllo wörld")]
    rows += [(100 + i, f"common line\nown {i}\n{body(60)}") for i in range(15)]
    return rows
