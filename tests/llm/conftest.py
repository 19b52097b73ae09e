import pytest
from pyspark.sql import Row

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, hash string, norm int, pack string, stay_id int, lang_pred string, pii_spans string"


def make(spark, rows):
    """Documents with extra columns whose names the operators use themselves."""
    full = [(k, t, lang, "s", None if t is None else len(t), "h", 1, "p", 2, "x", "y") for k, t, lang in rows]
    return spark.createDataFrame(full, SCHEMA)


@pytest.fixture()
def odd(spark):
    """Nulls, empty and very long texts, repeated rows."""
    long = " ".join(f"word{i % 977} tail{i % 31}" for i in range(60_000))
    return make(spark, [
        (1, None, None), (2, "", "en"), (3, " \t\n", None), (4, "a", "en"), (4, "a", "en"), (5, long, "en"),
        (6, "1234 !!", None), (None, "null id text here now", None), (7, "a", "fr"),
    ])


@pytest.fixture()
def none(spark):
    return make(spark, [])


@pytest.fixture()
def store(tmp_path):
    """Write documents as a table folder that a query can read."""
    def put(df):
        df.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
        return str(tmp_path)
    return put


@pytest.fixture(scope="session")
def rows_of():
    return lambda df: [r.asDict(recursive=True) if isinstance(r, Row) else r for r in df.collect()]
