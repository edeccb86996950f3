import random

import pytest

LONG = " ".join(f"word{i % 977}x{i % 13}" for i in range(30_000))


@pytest.fixture(scope="session")
def texts():
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(400)]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n)).capitalize() + "."
    passage = " ".join(say(9) for _ in range(7))
    base = [" ".join(say(rng.randint(3, 14)) for _ in range(rng.randint(3, 20))) for _ in range(60)]
    near = []
    for t in base[:12]:
        words = t.split(" ")
        for _ in range(3):
            w = list(words)
            w[rng.randrange(len(w))] = "changed"
            near.append(" ".join(w))
    shared = [f"{say(8)} {say(5)}\n{passage}\n{say(7)}" for _ in range(6)]
    odd = [None, "", " \t\n", "one", "two words", "A b C", "été naïve ß", "日本語 テキスト", "!!! ... ???", LONG, LONG, base[0], base[0]]
    return base + near + shared + odd


@pytest.fixture(scope="session")
def documents(spark, texts):
    """Nulls, repeated rows, ties, very long texts, and columns that clash with those the operators add."""
    rows = [(k * 3 + 1, t, ["a", "b", None, ""][k % 4], ["en", "fr", None][k % 3], 7, "x", 0.5) for k, t in enumerate(texts)]
    rows += [rows[3], rows[-1], (None, "a text without an id. It has two sentences.", "a", None, 1, "x", 0.1), (None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, size int, doc string, score double").repartition(5)


@pytest.fixture(scope="session")
def plain(documents):
    return documents.where("doc_id is not null").dropDuplicates(["doc_id"])
