import random

import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long, ids string, score double, _row string"


@pytest.fixture(scope="session")
def corpus():
    """Rows with nulls, empty and long texts, ties, repeats and near copies; columns that clash with the operators' own."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice(["ta", "lo", "mi", "ne", "ru", "so"]) for _ in range(rng.randint(1, 4)))
    text = lambda n: " ".join(word() + (".\n" if rng.random() < 0.1 else "") for _ in range(n))
    rows = [(i, text(rng.randint(10, 120))) for i in range(60)]
    base = rows[5][1].split(" ")
    rows += [(60 + i, " ".join(base[:k] + ["other"] + base[k + 1 :])) for i, k in enumerate((3, 9))]
    rows += [(70, rows[7][1]), (71, rows[7][1].upper()), (72, None), (73, ""), (74, " \n\t "), (75, "one two"), (76, "ONE two"), (77, text(6000)), (78, "x" * 30_000), (None, rows[8][1]), (None, None)]
    rows += [(20, rows[20][1]), (21, text(30)), (79, "éß Ünïcode ＦＵＬＬ 日本 \U0001f642 a  b <|endoftext|> it's I'LL 12,345"), (80, "tail \n"), (81, "same line here\nsame line here\n\nsame line here")]
    return [(i, t, rng.choice(["en", "de", None]), rng.choice(["a", "a", "b", None]), len(t) if t is not None else None, "clash", 0.5, "row") for i, t in rows]


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, DOC)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOC)
