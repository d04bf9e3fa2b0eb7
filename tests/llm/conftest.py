import random

import pytest

WORDS = "the of and red blue runs over lazy dog fox jumps high low mountain river stone tree leaf wind rain cloud night day sun moon star".split()


def prose(rng: random.Random, n: int, words=WORDS) -> str:
    out = []
    while len(out) < n:
        s = [rng.choice(words) for _ in range(rng.randint(4, 11))]
        out += [s[0].capitalize(), *s[1:-1], s[-1] + "."]
    return " ".join(out)


ODD = ["", None, " ", "\n\t", "a", "A", "a ", "x" * 5000, "1234 5678", "naïve Œuvre 日本語 😀", "<b>&amp;</b>", "word " * 3000]


@pytest.fixture(scope="session")
def docs(spark):
    """Copies, near copies, shared passages, odd texts, a repeated row, null columns, and columns named like an operator's own."""
    rng = random.Random(7)
    rows, passage = [], prose(rng, 60)
    for i in range(120):
        rows.append((i, prose(rng, rng.randint(3, 120)), rng.choice(["en", "fr", None]), rng.choice(["a", "b", "c", None, "é"])))
    for i in range(120, 150):
        t = rows[i - 100][1]
        rows.append((i, t if i % 3 else "  " + t.replace(" ", "\t", 3), "en", "a"))
    for i in range(150, 190):
        w = rows[i % 5 + 40][1].split() + passage.split() * 3
        w[rng.randrange(len(w))] = f"new{i}"
        rows.append((i, " ".join(w), "en", "b"))
    for i in range(190, 200):
        rows.append((i, prose(rng, 20) + " " + passage + " " + prose(rng, 20), "fr", "c"))
    rows += [(200 + i, t, "en", None) for i, t in enumerate(ODD)]
    rows += [rows[3], (None, "No id here at all.", "en", "a"), (None, None, None, None)]
    full = [(d, t, lang, s, len(t or ""), 1, 2.0, "k", "n") for d, t, lang, s in rows]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, size int, u double, key string, chunk string").repartition(5)


@pytest.fixture(scope="session")
def rows(docs):
    return [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in docs.collect()]


@pytest.fixture(scope="session")
def none(docs):
    return docs.filter("false")
