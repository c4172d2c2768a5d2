"""Small tables for the text operators: edge cases, and a few made-up documents with copies."""

import random

from pyspark.sql import types as T

#: Extra columns have names that operators might use themselves.
SCHEMA = T.StructType(
    [T.StructField(n, t) for n, t in [("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("n_chars", T.LongType()), ("h", T.StringType()), ("size", T.StringType()), ("words", T.StringType())]]
)


def frame(spark, texts, first=0, langs=None):
    rows = [(first + k, t, (langs or {}).get(first + k, "en"), "s", len(t or ""), "x", None, "y") for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def prose(rng, n, vocabulary=400):
    letters = "abcdefghijklmnopqrstuvwxyzéß"
    pool = [f"{letters[w % 26]}{letters[w // 26 % 26]}{letters[w * 5 % 28]}" for w in range(vocabulary)]
    return " ".join(rng.choice(pool) for _ in range(n))


def corpus(seed=1, n=40):
    """Texts with whole copies, shared passages, repeats inside, odd spaces, one long text, empty and null ones."""
    rng = random.Random(seed)
    base = [prose(rng, rng.randint(1, 120)) for _ in range(n)]
    shared = prose(rng, 45)
    out = []
    for k, t in enumerate(base):
        if k % 5 == 1:
            t = t + " " + shared + " " + prose(rng, 10)
        if k % 7 == 2:
            t = base[k // 2]
        if k % 11 == 3:
            w = t.split()
            w[len(w) // 2] = "edited"
            t = " ".join(base[k - 3].split()[:5] + w)
        if k % 13 == 4:
            t = "la la la " * 30 + t
        if k % 6 == 5:
            t = t.replace(" ", "\n", 3).replace(" ", "\t \x0b", 2)
        out.append(t)
    return [*out, None, "", " \n ", "one", shared, "x" * 3000, prose(rng, 4000), " nbsp em  é😀 ñ"]
