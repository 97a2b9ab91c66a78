import pytest

#: Rows that every operator must stand: null and empty texts, repeats, a null id, a very long text, and columns that clash with inner names.
ODD = [(1, "a b c d e"), (2, None), (3, ""), (4, "a b c d e"), (4, "a b c d e"), (5, "é" * 3000 + " " + "word " * 3000), (6, "  \n\t "), (None, "no id here")]


@pytest.fixture(scope="session")
def odd(spark):
    names = "fp string, id int, _id int, kept boolean, _leaks string, _lines int, h int, _h int, host string, _doc string, row int, run int, _c0 int, _items string, votes string, `a.b` int"
    return spark.createDataFrame([(i, t, "x", 0, 1, True, "l", 2, 3, 4, "w", "d", 5, 6, 7, "i", "v", 8) for i, t in ODD], f"doc_id long, text string, {names}")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, extra int")
