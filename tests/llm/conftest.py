import pytest

ODD = "doc_id long, text string, lang string, source string, n_chars long, score string, spans int, hits int, items int, n_lines string, n_dropped int, kept int, fp int, ids int, media int, lang_pred int, batch int, anchor int"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, repeated rows and ids, and columns with clashing names."""
    rest = ("x", 1, 2, 3, "y", 4, 5, 6, 7, 8, 9, 10, 11)
    long = " ".join(f"word{i % 977} The IDIOT number {i}" for i in range(30_000)) + "\n" + "é" * 5000
    same = "The quick brown fox jumps over the lazy dog and then some more words follow it here, " * 3
    rows = [
        (1, None, None, None, None), (None, "no id at all, plain words", "en", "s", 3), (2, "", "fr", "s", 0), (3, long, "en", "s", len(long)), (4, same, "en", "s", 9), (4, same, "en", "s", 9),
        (4, same + "tail", "en", None, 9), (5, same, "en", "s", 9), (None, None, None, None, None), (6, "  \t\r\n\n ", "de", "t", 1), (7, "12345 678 !!", "de", "t", 1), (8, "ß", "de", "t", 1),
        (9, "\U0001f600\U0001f601 漢字 ß́", "de", "t", 1),
    ]
    return spark.createDataFrame([(*r, *rest) for r in rows], ODD)


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.limit(0)
