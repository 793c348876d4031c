import pytest

from contactflow.session import local_session

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, key string"
LONG = " ".join(f"word{k % 997}x{k % 7}" for k in range(30_000))
ODD = [None, "", "   \n\t ", "\n\n", "one", "a\nb\nc", "a\nb\nc", "x " * 200, LONG, LONG, "Füße ñandú 日本 <|endoftext|> \u0000 end", "  two  spaces \n here "]


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = local_session(8, "contactflow-tests")
    if not s.conf.get("spark.checkpoint.dir", None):
        s.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))
    return s


@pytest.fixture(scope="session")
def odd(spark):
    """Null ids, texts and hosts, repeated rows, ties, a very long text, and extra columns with clashing names."""
    rows = [(None if k == 3 else k, t, None if k % 4 == 0 else "en", None if k % 3 == 0 else "h", None, "k", None) for k, t in enumerate(ODD)]
    return spark.createDataFrame(rows + [rows[5], rows[0]], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
