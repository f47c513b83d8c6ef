import random

import pytest
from pyspark.sql import functions as F

SYLLABLES = "an be co du er fi go ha in jo ka lu me no or pa qui ro sa te".split()


def prose(rng, words):
    out = []
    for k in range(words):
        w = "".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4)))
        out.append(w + ("." if k % 11 == 10 else ""))
    return " ".join(out)


@pytest.fixture(scope="session")
def corpus():
    """``(doc_id, text)`` rows with copies, near copies, shared lines and passages, odd white
    space, empty and null texts, repeated rows and a long text."""
    rng = random.Random(5)
    base = [prose(rng, rng.randint(30, 120)) for _ in range(24)]
    line = "A shared Line that is long enough to be a key, é"
    passage = prose(rng, 60)
    rows = []
    for k, t in enumerate(base):
        rows.append((3 * k + 1, t))
    rows += [(100, base[0]), (101, base[0]), (102, base[1] + " tail words here"), (103, base[1].replace("an", "AN"))]
    for k in range(6):
        rows.append((110 + k, f"{prose(rng, 20)}\n  {line.replace('shared', 'SHARED') if k % 2 else line}\t\n{prose(rng, 9)}"))
    for k in range(4):
        rows.append((120 + k, prose(rng, 30) + " " + passage + " " + prose(rng, 30)))
    many = base[2].split(" ")
    for k in range(14):  # a chain of near copies
        w = list(many)
        for j in range(k):
            w[(5 * j) % len(w)] = f"x{j}"
        rows.append((130 + k, " ".join(w)))
    rows += [(200, ""), (201, None), (202, " \t\n "), (203, "word"), (204, "two words"), (205, "two words"), (206, "12 34 !!"),
             (207, "é" * 39), (208, "é" * 60 + "\n" + "é" * 60), (209, "\n\n\n"), (210, "a  b\r\n\x0b c\x0cd"), (211, "naïve café – déjà vu — ½ 日本語 текст"),
             (212, " ".join([prose(rng, 40)] * 60)), (213, "aaaa" * 400), (213, "aaaa" * 400), (None, base[3]), (None, None)]
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    """The corpus with columns that clash with names inside the operators."""
    df = spark.createDataFrame([(i, t, i, "k", 1.0, "x") for i, t in corpus], "doc_id long, text string, u long, component string, n double, _hash string")
    return df.repartition(3).cache()


@pytest.fixture(scope="session")
def empty(docs):
    return docs.where(F.lit(False))
