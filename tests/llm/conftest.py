"""Documents with every odd case: nulls, empty and long texts, copies, repeated rows, clashing columns."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words long, fp long, __row string, host string"


def make_documents():
    rnd = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "été", "Straße", "über", "naïve", "the", "of", "and", "x1", "42", "tion", "ing"]
    prose = lambda n: " ".join(rnd.choice(words) + rnd.choice(["", "", "", ".", ","]) for _ in range(n))
    rows = []
    for i in range(60):
        text = "\n".join(prose(rnd.randint(1, 30)) for _ in range(rnd.randint(1, 6)))
        if i % 3 == 0:
            text += "\nAll rights are reserved here."
        rows.append((i, text, rnd.choice(["en", "fr", None]), f"s{i % 7}"))
    long = prose(4000)
    rows += [
        (60, None, "en", "s1"), (61, "", "en", "s1"), (62, "   \n\t ", None, "s2"), (63, "###", "fr", None), (64, "one", "en", "s3"), (65, "one two", "en", "s3"),
        (66, long, "en", "s4"), (67, long.replace("alpha", "ALPHA", 1), "en", "s5"), (68, long + " more", "en", "s6"), (69, "日本語のテキスト \U0001f600  two  spaces\n ends ", "en", "s1"),
        (None, "no id here at all", "en", "s1"), (70, "<|endoftext|> special <|endoftext|>", "en", "s2"), (71, "\x1c odd \x85 space\xa0s  ", "en", "s2"),
    ]
    rows += [rows[3], rows[3], (72, rows[3][1], "en", "s6"), (73, rows[4][1].upper(), "en", "s6")]
    return [(*r, 1, 2, 3, "clash", "clash") for r in rows]


@pytest.fixture(scope="session")
def rows():
    return make_documents()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def vocabulary_file():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
