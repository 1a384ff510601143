import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i} and" for i in range(30_000))


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with every awkward case, and an extra column whose name clashes."""
    base = "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon. " * 3
    rows = [
        (1, base, "en", "a", len(base)), (2, base, "en", "a", len(base)), (2, base, "en", "a", len(base)),
        (3, base + "one more", "en", None, None), (4, None, None, None, None), (5, "", "en", "b", 0), (6, " \n\t ", "xx", "b", 4),
        (None, "Write to jo.doe@example.com or +1 (017) 555-7713 now please, it is urgent for us all", "en", "c", 1),
        (7, LONG, "en", "a", len(LONG)), (8, "Ünïcödé ﬁ é 日本語 😀 <|endoftext|> don't WE'LL", "de", "ü", 9), (None, None, None, None, None),
    ]
    schema = DOCUMENTS + ", size long, component_id string, spans string, cell int"
    return spark.createDataFrame([(*r, 7, "x", "y", 1) for r in rows], schema)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCUMENTS)


@pytest.fixture
def stored(spark, tmp_path):
    """Writes tables where queries look for them."""

    def put(**tables):
        for name, df in tables.items():
            df.write.parquet(str(tmp_path / f"{name}.parquet"))
        return str(tmp_path)

    return put
