import random

import pytest

#: Extra columns carry names that the operators use themselves.
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, words int, lines int, h int, d1 int, piece int, length int, "
          "keys string, kept int, row string, host string, score double, spans int, ids int, node int")
EXTRA = (1, 2, 3, 4, 5, 6, "k", 7, "r", "x", 0.5, 8, 9, 10)

EN = "the of and to in that is was for on with as it by this be at from".split()
FR = "le la les de des du un une et en que qui dans pour pas sur au avec".split()


def sentence(rng, stock, n):
    made = [rng.choice(stock) if rng.random() < 0.5 else "".join(rng.choice(("th", "er", "on", "an", "re", "ti", "es", "st"))
                                                                 for _ in range(rng.randint(2, 5))) for _ in range(n)]
    return " ".join(made).capitalize() + "."


def article(seed, stock=EN, lines=6, n=14):
    rng = random.Random(seed)
    return "\n".join(sentence(rng, stock, n) for _ in range(lines))


def french(seed, lines=6, n=14):
    rng = random.Random(seed)
    return "\n".join(" ".join(rng.choice(FR) if rng.random() < 0.5 else "".join(rng.choice(("eau", "que", "oi", "ai", "ment", "é", "è", "ou"))
                                                                              for _ in range(rng.randint(2, 4))) for _ in range(n)) for _ in range(lines))


def make_docs(spark, rows):
    """rows: (doc_id, text) or (doc_id, text, lang)."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", None if r[1] is None else len(r[1]), *EXTRA) for r in rows]
    return spark.createDataFrame(full, SCHEMA)


@pytest.fixture(scope="session")
def odd_rows():
    """Null and empty texts, null ids, repeated rows, equal texts, blanks only, one very long text, marks and emoji."""
    long = article(1, lines=1500)
    return [
        (1, None), (2, ""), (3, " \n\t "), (4, article(4)), (4, article(4)), (5, article(4)), (None, article(6)), (None, None),
        (7, "one"), (8, "x" * 70_000), (9, long), (10, "a\x00b | # % 🙂 é ▁ <|endoftext|>   '  's \r\n end"), (11, article(11, lines=1)),
        (12, article(12) + "\n" + article(4)),
    ]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return make_docs(spark, odd_rows)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
