"""One table of odd cases that every operator on documents has to take."""

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, n_tokens long, digest string, kept string, lines string, words string, length int, runs string"
EXTRA = (7, "x", "y", "z", "w", 3, "r")

LONG = " ".join(f"word{k % 997} the of and {k}" for k in range(20_000))
TEXTS = {
    1: None,
    2: "",
    3: "   \n\t ",
    4: "1234 !!! 567",
    5: "The of and the of and the of and.",
    6: "the OF and the of and the of and.",
    7: "É è ü ß 日本語 \x1c\x85\xa0 naïve",
    8: "a  b   c \n\n d",
    9: "end <|endoftext|> middle<|endoftext|>",
    10: LONG,
    11: LONG + " tail",
    12: "x" * 5_000,
    13: "one two three",
    14: "one two three",
    16: "client_id=abc " + "a.Q" * 100_000,
    15: "\ud7ff\ue000 😀 odd \x00 bytes",
}


@pytest.fixture(scope="session")
def odd(spark):
    rows = [(i, t, "en" if i % 2 else None, "s", len(t or ""), *EXTRA) for i, t in TEXTS.items()]
    rows += [rows[4], rows[9], (None, "no id here at all", "en", None, None, *EXTRA), (None, None, None, None, None, *EXTRA)]
    return spark.createDataFrame(rows, COLUMNS).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
