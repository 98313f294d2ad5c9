import pytest


@pytest.fixture(scope="session")
def docs(spark, data):
    from orrery.llm.common import documents

    return documents(spark, data)


#: Rows that every operator on documents must stand: nulls, empty, long, repeated, clashing extra columns.
ODD = [
    (1, "one two three four five six seven eight nine ten eleven twelve", "en", "a", 60, "x"),
    (1, "one two three four five six seven eight nine ten eleven twelve", "en", "a", 60, "x"),
    (2, None, None, None, None, None),
    (3, "", "de", "a", 0, None),
    (None, "ein Text ohne Nummer, mit a@b.co und +1 (743) 555-3824", "de", None, 10, "y"),
    (4, "  \n\t \n", "fr", "b", 5, "y"),
    (5, "lang " * 30000, "de", "b", 150000, "z"),
    (6, "😀 日本語 é " * 30, None, "c", 9, "z"),
]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string, n_chars long, did string")


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
