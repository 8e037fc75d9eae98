import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """Documents from tuples (doc_id, text, lang, source)."""

    def make(*rows):
        full = [(*r, None, None, None)[:4] for r in rows]
        return spark.createDataFrame([(*r, len(r[1] or "")) for r in full], DOCUMENTS)

    return make


@pytest.fixture
def folder(tmp_path, spark):
    """Write tables for a query: name -> DataFrame."""

    def write(**tables):
        for name, df in tables.items():
            df.write.parquet(str(tmp_path / f"{name}.parquet"))
        return str(tmp_path)

    return write
