import random

import pytest

#: Extra columns whose names the operators use inside, or give out themselves.
CLASH = "doc_id long, text string, lang string, source string, n_chars long, row string, rk long, h long, size long, copies long, score double, r long, _1 long, shard int, cid long, spans string"


def clash(rows):
    return [(d, t, lang, s, None if t is None else len(t), "row", 1, 2, 3, 4, 0.5, 6, 7, 8, 9, "x") for d, t, lang, s in rows]


@pytest.fixture(scope="session")
def words():
    rng = random.Random(0)
    return ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(400)]


@pytest.fixture(scope="session")
def corpus(words):
    """Rows (doc_id, text, lang, source): plain texts, nulls, empty and long texts, copies, near copies, shared passages, repeated rows."""
    rng = random.Random(1)
    said = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(k, said(rng.randint(1, 120)), rng.choice(["en", "de", None]), f"s{rng.randint(0, 3)}") for k in range(60)]
    passage, base = said(60), said(100)
    rows += [(100 + k, f"{said(20)}\n{passage}\t{said(15)}", "en", "s0") for k in range(5)]
    for k in range(8):
        near = base.split()
        near[rng.randrange(100)] = f"other{k}"
        rows.append((120 + k, " ".join(near), "en", "s1"))
    rows += [(140 + k, "same text\nof several\n lines" + " " * k, "en", "s2") for k in range(4)]
    rows += [(150, None, None, None), (151, "", "en", None), (152, "   \n\t", "en", "s0"), (None, "a text without an id but with six words", None, None), (None, None, None, None)]
    rows += [(160, said(6000), "en", "s0"), (161, "word " * 3000, "en", "s3"), (162, "x" * 50_000, "en", "s3"), (163, "é ü   ñ", "en", "ä")]
    rows += [rows[3], rows[3], (170, rows[5][1], "en", "s1")]
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(clash(corpus), CLASH).repartition(5)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], CLASH)
