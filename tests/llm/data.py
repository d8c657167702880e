"""Small documents for the tests, with all the odd cases."""

import random

#: Columns whose names the operators also use inside.
CLASHES = ["t", "n", "ids", "bucket", "keys", "shard", "pos", "_row", "held", "grp", "y", "task", "label", "score", "component_id"]


def words(rnd, n, vocabulary=400):
    return " ".join(f"w{rnd.randrange(vocabulary)}" for _ in range(n))


def odd_documents(spark, n=40, seed=1, long_words=30_000):
    """Documents with nulls in every column, empty, blank and very long texts, repeated rows and clashing columns."""
    rnd = random.Random(seed)
    rows = [(i, words(rnd, rnd.randrange(5, 200)), rnd.choice(["en", "fr", None]), rnd.choice(["a", "b", None])) for i in range(n)]
    rows += [(n, None, "en", "a"), (n + 1, "", None, None), (n + 2, " \n\t ", "en", "b"), (None, "no id here " * 9, "en", "a"), (n + 3, words(rnd, long_words), "en", "a"), (n + 4, "Ünï cödé שלום 😀 …", "de", "c")]
    rows += [rows[0], rows[0], (None, None, None, None)]
    schema = "doc_id long, text string, lang string, source string, " + ", ".join(f"{c} string" for c in CLASHES)
    return spark.createDataFrame([(*r, *["x"] * len(CLASHES)) for r in rows], schema)


def empty_documents(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string")
