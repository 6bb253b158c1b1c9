"""Small tables with the awkward rows that every operator has to bear."""

import random

from pyspark.sql import types as T

DOCS = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
)
#: Columns whose names operators use inside.
CLASHING = ["key", "ids", "node", "n_lines", "kept", "piece", "length", "rules", "base", "token", "label"]


def words(rng, n):
    return [rng.choice("alpha beta gamma delta omega sigma kappa theta iota lambda zeta eta rho tau chi psi".split()) + rng.choice("abcdefghij") for _ in range(n)]


def texts(seed=3):
    """Texts with nulls, blanks, long ones, exact and near copies, repeated lines and odd characters."""
    rng = random.Random(seed)
    base = [" ".join(words(rng, rng.randint(5, 120))) for _ in range(30)]
    near = []
    for t in base[:8]:
        w = t.split(" ")
        w[len(w) // 2] = "changed"
        near.append(" ".join(w))
    shared = ["This line stands in many documents, number %d." % i for i in range(12)]
    lined = [f"{b}\n{s}\nown {i}" for i, (b, s) in enumerate(zip(base[8:20], shared))]
    odd = [None, "", " ", "\n\n", "one", "one two", "ONE two", "a b c d", "A B C D", "é è 漢字 🙂 \t x", "x" * 50_000, "word " * 20_000, "<|endoftext|> and <|startoftext|>", "tab\tand\x0bmore  spaces \n end "]
    return base + near + base[:5] + lined + odd


def documents(spark, rows=None, clash=False):
    rows = texts() if rows is None else rows
    data = [(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(rows)]
    if data:
        data += [data[0], (None, "a text without an id", None, None, None)]
    df = spark.createDataFrame(data, DOCS)
    if clash:
        for c in CLASHING:
            df = df.withColumn(c, df["source"])
    return df


def empty(spark):
    return spark.createDataFrame([], DOCS)
