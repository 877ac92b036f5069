import pytest

#: Null and empty texts, ties, repeated rows, a null id, a very long text and one that is a single long word.
ROWS = [
    (1, None), (2, ""), (3, "one"), (4, "one"), (5, "a b c d e f"), (5, "a b c d e f"), (6, " \n\t \n"), (7, "Mail bob@example.com or +1 (555) 123-4567.\nIP 10.0.0.1, card 4111 1111 1111 1111."),
    (8, "word " * 40_000), (9, "x" * 100_000), (10, "line one is here\nline one is here\nline two"), (None, "a text without an id"), (11, "ünï cödé ▁ 漢字 \U0001f600  two  spaces "), (12, "the idiot and the fool " * 30),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, score double, fp long, h long, key string, target string, words string, path string, _id long, _h long, _rn long, _got string, _copy long, _ranges string, _kept long, rid long, row string, own_id long, own_th long, th long, tie long, id long, got string, copy int, ranges string, start long, part int, n long, c long, hub string, u long, v long, u_ long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Documents with every odd case, and further columns named like the operators' own."""
    rows = [(i, t, "en", None if k % 4 == 0 else f"src{k % 3}", None if t is None else len(t), k, 0.5, k, k, "k", "t", "w", "p", k, k, k, "g", k, "r", k, 0, "row", k, k, k, k, 0, "got", 1, "rng", 0, 1, 2, 3, "hub", 4, 5, 6) for k, (i, t) in enumerate(ROWS)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
