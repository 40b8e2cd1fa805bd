import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows_of(*texts):
    return [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table of texts, ids from 0; or of whole rows."""

    def make(*texts, rows=None):
        return spark.createDataFrame(rows_of(*texts) if rows is None else rows, SCHEMA)

    return make


@pytest.fixture(scope="session")
def odd(spark):
    """Null ids and texts, empty and repeated rows, a long text, and columns whose names operators use."""
    long = " ".join(f"w{i % 977} word{i}" for i in range(30_000))
    rows = [(0, "a b c d e f"), (1, None), (2, ""), (3, "a b c d e f"), (3, "a b c d e f"), (None, "Null id here"), (None, None), (4, long), (5, " \t\n "), (6, "ünïcode ß 日本 😀"), (7, "a  b\tc d e f")]
    clash = "digest string, uid long, fp string, n_tokens string, slot int, _bucket int, label string, k1 string, size string, component_id string, _digest string, score string"
    return spark.createDataFrame([(*r, "x", 1, "x", "x", 1, 1, "x", "x", "x", "x", "x", "x") for r in rows], f"doc_id long, text string, {clash}")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def table_dir(path, **tables):
    for name, df in tables.items():
        df.write.parquet(f"{path}/{name}.parquet")
    return str(path)


@pytest.fixture
def write_tables(tmp_path):
    return lambda **tables: table_dir(tmp_path / "tables", **tables)
