import pytest

#: Columns whose names the operators use themselves.
CLASHING = ("kept", "n_words", "size", "h", "node", "keys", "items", "score", "held_out", "row", "part", "t", "copies", "url_key", "seed")


def frame(spark, rows, columns="doc_id long, text string, lang string, source string, n_chars long"):
    """Rows as documents, with more columns whose names clash."""
    names = [c.split()[0] for c in columns.split(", ")]
    more = [c for c in CLASHING if c not in names]
    schema = columns + "".join(f", {c} string" for c in more)
    return spark.createDataFrame([(*r, *["x"] * len(more)) for r in rows], schema)


LONG = "lorem ipsum dolor sit amet consectetur " * 3000
ODD = [
    (1, None, "en", "a", 0),
    (2, "", "en", None, 0),
    (3, " \n\t ", None, "b", 4),
    (4, "one", "fr", "b", 3),
    (4, "one", "fr", "b", 3),
    (None, "no id at all", "en", "a", 12),
    (None, None, None, None, None),
    (5, LONG, "en", "a", len(LONG)),
    (6, "x" * 50_000, "en", "c", 50_000),
    (7, "é ü   ß\n\n  end  ", "de", "c", 20),
    (8, "<|endoftext|> !!! 😀 \U0001f600", "en", "a", 20),
]


@pytest.fixture()
def odd(spark):
    return frame(spark, ODD)


@pytest.fixture()
def empty(spark):
    return frame(spark, [])
