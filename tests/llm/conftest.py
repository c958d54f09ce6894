import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, n int, sig bigint, token bigint, line string, spans string, tag string, label int, ids string, start int, __key bigint, __gone array<int>, __copy bigint, __leak bigint, __lang string, copy bigint, leak string, lost int, key_of_lost bigint, bits binary, bands int, first bigint, kept int"


@pytest.fixture
def docs(spark):
    """Make a documents table with columns of clashing names from (doc_id, text[, lang]) rows."""

    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", None, 1, 2, 3, "x", "y", "z", 1, "i", 4, 7, [0], 1, 1, "l", 1, "k", 0, 1, b"b", 5, 6, 8) for r in rows]
        return spark.createDataFrame(full, SCHEMA).repartition(3)

    return make


WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


@pytest.fixture
def odd_rows():
    """Nulls, empty, white space, very long, repeated and tied rows."""
    long = " ".join(f"w{i}" for i in range(6000))
    base = " ".join(WORDS * 3)
    return [(1, base), (2, base), (2, base), (3, base + " end"), (4, None), (5, ""), (6, " \n\t "), (7, long), (8, long + " more"), (9, "a\nb\n\na"), (None, base), (None, None), (10, "é漢字 ﬁ 😀 " + base), (11, "x" * 5000), (12, "one two"), (13, "one two")]
