import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, did string, th long, key string, _source string"
LONG = " ".join(f"word{i % 977} other{i * 7 % 1013}" for i in range(20000))
BASE = " ".join(f"t{i * 37 % 211}x{i}" for i in range(120))
PASSAGE = " ".join(f"passage{i}" for i in range(60))


def near(k: int) -> str:
    w = BASE.split()
    w[10 + k] = f"edit{k}"
    return " ".join(w)


TEXTS = [
    BASE, BASE, near(1), near(2), near(50), "short", "short", "two words", "", None, "   \n\t ", LONG, f"{PASSAGE} alpha beta gamma", f"delta {PASSAGE} epsilon", "é" * 250 + " x", "a" * 300,
    "Ünïcödé ТЕКСТ 漢字 <|endoftext|> don't \x1c ok ΑΣ", "The quick brown fox. " * 30, "### %%% *** " * 20, "One line of text here\nOne line of text here\nand another",
]


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls in every column, repeated rows, empty and very long texts, near copies, and extra columns that operators use inside."""
    rows = [(i, t, "en", f"src{i % 3}", len(t or ""), "x", 1, "k", "s") for i, t in enumerate(TEXTS)]
    rows += [(0, BASE, "en", "src0", len(BASE), "x", 1, "k", "s"), (None, BASE, None, None, None, None, None, None, None), (None, "no id here at all", None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, COLUMNS)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], COLUMNS)
