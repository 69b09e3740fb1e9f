import random

import pytest

#: Names that operators use inside, as columns of the input.
CLASHING = ["id", "n", "text_hash", "gram", "score", "rest", "label", "key", "n_words", "spans", "part", "held_out", "null_text", "copies", "start"]


def prose(rng: random.Random, n: int, words: list[str]) -> str:
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.fixture(scope="session")
def messy():
    """Rows (doc_id, text): null and empty texts, a null id, repeated rows, copies, near copies, shared passages, one long text."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefgé") for _ in range(rng.randint(1, 6))) for _ in range(400)]
    texts = [prose(rng, rng.randint(5, 120), vocabulary) for _ in range(60)]
    passage = prose(rng, 90, vocabulary)
    for i in range(0, 20, 4):
        texts[i] += " " + passage + " " + prose(rng, 5, vocabulary)
    near = texts[30].split()
    for i in range(8):
        w = list(near)
        w[rng.randrange(len(w))] = f"changed{i}"
        texts.append(" ".join(w))
    texts += [texts[3]] * 4 + ["", None, "!!! ...", "one", "Two Words", "a" * 1500, prose(rng, 4000, vocabulary), "x  y\n\n z\t <|endoftext|> ok", "ΣΑΣ İstanbul 日本語 ½"]
    rows = list(enumerate(texts))
    return rows + [(3, texts[3]), (None, texts[40]), (None, None)]


@pytest.fixture(scope="session")
def documents(spark, messy):
    """The rows as a frame with columns of clashing names."""
    schema = "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in CLASHING)
    return spark.createDataFrame([(i, t, *(["z"] * len(CLASHING))) for i, t in messy], schema).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string")
