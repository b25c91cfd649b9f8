import pytest

SF = "/root/testdata/sf0.001"
EDGE_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, owner string, score double, kept boolean"


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def edges(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and columns with names that clash."""
    long_text = " ".join(f"word{i % 997} the and" for i in range(60_000))
    rows = [
        (1, "The cat, sat on the mat.", "en", "a", 24), (2, "The  cat,\tsat\non the mat.", "en", "a", 24), (3, None, "en", "a", None),
        (4, "", "fr", None, 0), (4, "", "fr", None, 0), (None, "Licensed under CC BY-NC 4.0.", None, None, None),
        (None, None, None, None, None), (7, "   ", "en", "a", 3), (8, long_text, "en", "b", len(long_text)), (9, long_text, "en", "b", 1),
        (10, "12 34 !!", "en", "b", 8), (11, "Él está aquí, señor; ÀÉÎ", "es", "b", 1), (11, "another text with the same id", "en", "b", 1),
        (12, "x", "en", "b", 1), (13, "x", "en", "b", 1), (13, "x", "en", "b", 1), (14, "日本語のテキスト", None, "b", 8),
        (16, "released under mit license", "en", "b", 1), (16, "released under mit license", "en", "b", 1),
        (15, "GNU General Public License mit license MIT LICENSE apache license", "en", "b", 1),
    ]
    return spark.createDataFrame([(*r, "owner", 0.5, True) for r in rows], EDGE_SCHEMA)


@pytest.fixture(scope="session")
def nothing(edges):
    return edges.limit(0)
