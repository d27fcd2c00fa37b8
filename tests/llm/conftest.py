"""Small document tables with the odd cases that every operator has to take."""

import random

import pytest

KIND = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randint(0, vocabulary)}" for _ in range(n))


@pytest.fixture(scope="session")
def docs(spark):
    """60 documents: copies, near copies, shared passages, nulls, blanks, repeats of one word, a long text."""
    rng = random.Random(11)
    texts = [prose(rng, rng.randint(1, 160)) for _ in range(30)]
    texts = [t.replace(" w1", "\nw1") for t in texts]
    passage = prose(rng, 70)
    texts += [texts[0], texts[0], texts[5]]
    base = prose(rng, 120).split()
    for i in range(8):
        words = list(base)
        for _ in range(i):
            words[rng.randrange(len(words))] = f"x{rng.randint(0, 99)}"
        texts.append(" ".join(words))
    texts += [f"{prose(rng, 20)} {passage} {prose(rng, 15)}" for _ in range(4)]
    texts += [None, "", " \n\t ", "one", "one two", "One TWO", "a " * 90, "a\n" * 40, "Ärger über ß … 中文 🙂 ", "x" * 3000, prose(rng, 6000, 50), passage]
    texts += ["same line\n" * 3 + prose(rng, 5), "first\nsame line\nsame line\nsame line\nlast"]
    rows = [(i, t, "en", [None, "", "a", "b", "hot"][min(4, i % 7)], len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, KIND).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], KIND)


@pytest.fixture(scope="session")
def odd(docs):
    """docs with repeated rows, null keys and columns whose names the operators use inside."""
    from pyspark.sql import functions as F

    rows = docs.unionByName(docs.where("doc_id % 5 = 0")).unionByName(docs.limit(3).withColumn("doc_id", F.lit(None).cast("long")))
    for name in ("rk", "row", "w", "c", "key", "size", "item", "n_removed", "taken", "score"):
        rows = rows.withColumn(name, F.lit(1))
    return rows.cache()


def rows_of(df):
    return [r.asDict(recursive=True) for r in df.collect()]
