import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words long, key string, kept string, at long"


def prose(rng, n, vocabulary=400):
    return " ".join("".join(rng.choice("aeioulnrst") for _ in range(2 + int(rng.random() * rng.random() * 7))) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """Texts of all odd kinds by id: null, empty, white space, short, long, repeated, near copies, personal data."""
    rng = random.Random(11)
    long = prose(rng, 4000)
    base = prose(rng, 120)
    words = base.split(" ")
    near = " ".join(words[:60] + ["changed"] + words[61:])
    passage = prose(rng, 60)
    out = {0: None, 1: "", 2: " \t\n ", 3: "one", 4: "One", 5: "two words", 6: long, 7: long, 8: base, 9: near, 10: base}
    out[11] = prose(rng, 40) + " " + passage + "\n" + prose(rng, 30)
    out[12] = prose(rng, 35) + "\n" + passage + " " + prose(rng, 50)
    out[13] = "\n".join(["the same line of some words here again"] * 30)
    out[14] = "mail a.b+c@ex-ample.co.uk, x@y or p@q.r@s.t, ip 1.2.3.4.5.6.7.8 and 300.1.1.1, card 4111 1111 1111 1111 x 4111-1111-1111-1112, phone +1 (555) 123-4567 or +12 and +1 2"
    out[15] = "Été straße naïve — ünïcödé 😀 " + prose(rng, 30)
    out[16] = "### $$$ %%% " * 40
    out[17] = "double  spaces and   odd ones \n\n <|endoftext|> end "
    for i in range(18, 60):
        out[i] = prose(rng, rng.randint(5, 300))
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    """Rows with clashing extra columns, null keys, languages and sources, and one row repeated."""
    rows = [(i, t, ("en", "fr", None)[i % 3], ("a", "b", None, "a", "a")[i % 5], None if t is None else len(t), 7, "k", "x", 1) for i, t in texts.items()]
    return spark.createDataFrame([*rows, rows[20], (None, "a row without a key " * 20, "en", "a", 400, 7, "k", "x", 1)], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
