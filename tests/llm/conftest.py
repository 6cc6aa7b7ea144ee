import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, k_id string, t_norm string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


def hard_rows():
    """Nulls in every column, empty, blank, short and long texts, ties, repeated rows and ids, odd characters."""
    rng = random.Random(5)
    shared = sentence(rng, 60)
    long = sentence(rng, 4000)
    texts = [
        None, "", " \n\t ", "one", "two words", "!!! ??? ...", shared, shared, shared + " tail", sentence(rng, 12) + " " + shared + " " + sentence(rng, 9),
        "\n".join([sentence(rng, 8)] * 7), "x\ny\nz\n" * 5, "Ünïcödé ñandú straße déjà vu 漢字 かな emoji 😀 ́combining", "a<|endoftext|>b <|startoftext|> c", "tab\tline\x0bfeed\x0c\x85\xa0nbsp",
        long, long[:-200] + " changed near the end", "A" * 5000, "ab " * 900, "\x00\x01 control \x1c separators \x1f", "don't it's we'll 'S 'T I'M", "İstanbul ΑΣ ΣΑΣ ǅ",
    ]
    rows = [(i, t, ["en", "fr", None][i % 3], ["h1", "h2", None][i % 3], len(t) if t else None, "own row", None, "own norm") for i, t in enumerate(texts)]
    rows += [rows[7], rows[7], (None, "no id here at all", None, None, None, None, None, None), (None, None, None, None, None, None, None, None), (3, "another text under a used id", "en", "h1", 5, None, None, None)]
    return rows


@pytest.fixture(scope="session")
def hard(spark):
    return spark.createDataFrame(hard_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
