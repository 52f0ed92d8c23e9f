import pytest

LONG = "\n".join(" ".join(f"w{i}x{j}" for j in range(40)) for i in range(600))  # 24,000 words, 180,000 characters
NEAR = " ".join(f"term{i}" for i in range(200))
ROWS = [
    (1, "Plain words in a plain text, and a few more of them to read.", "en", "a"),
    (2, None, "en", None),
    (3, "", None, "a"),
    (4, " \t\n ", "en", "b"),
    (5, "one", "de", "b"),
    (6, "two words", "fr", ""),
    (7, LONG, "en", "a"),
    (8, NEAR, "en", "c"),
    (9, NEAR.replace("term199", "other"), "en", "c"),
    (9, NEAR.replace("term199", "other"), "en", "c"),
    (10, NEAR, None, None),
    (11, "ÀÉ ñandú 漢字 ßtraße İ 😀 x y", "es", "d"),
    (12, "THE THE THE THE !!! *** | # $ % & < >", "en", "d"),
    (None, "a row without an id", "en", "d"),
    (-5, "Released under the MIT License.\nSee the Apache  License; GNU General Public License!", "en", "e"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and extra columns with clashing names."""
    rows = [(i, t, lang, s, None if t is None else len(t), 7, 1.5, "x", True) for i, t, lang, s in ROWS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size long, "
                                       "target double, node string, label boolean")


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
