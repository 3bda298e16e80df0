import datetime

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    """documents from texts, or from (doc_id, text) pairs; with an extra column whose name operators use themselves."""

    def make(texts, lang="en"):
        rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
        return spark.createDataFrame([(i, t, lang, "s", len(t or ""), -1.0, "x") for i, t in rows], DOCS + ", score double, fold string")

    return make


@pytest.fixture(scope="session")
def folder(spark, tmp_path_factory):
    """A folder of tables, written from DataFrames."""

    def write(**tables):
        where = tmp_path_factory.mktemp("tables")
        for name, df in tables.items():
            df.write.parquet(f"{where}/{name}.parquet")
        return str(where)

    return write


ODD = ["", "   ", None, "a", "one two", "the same text", "the same text", "x" * 5000, "ä ö ü ß é ñ 日本語 テスト", "line\nline\nline", "\x00\x1f tab\there", "😀 😀😀", "don't <|endoftext|> stop <|startoftext|>"]


@pytest.fixture(scope="session")
def odd():
    return list(ODD)


def utc(*args):
    return datetime.datetime(*args, tzinfo=datetime.UTC)
