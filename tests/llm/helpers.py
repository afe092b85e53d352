"""Small tables for the tests: every odd case in one place."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def odd_texts(seed=3):
    """Texts with copies, near copies, shared passages, nulls, blanks, junk and one very long text."""
    rng = random.Random(seed)
    base = words(rng, 300)
    passage = words(rng, 90)
    near = base.split()
    near[150] = "changed"
    return [
        base, base, " ".join(near), base.upper(), None, "", " \t\n ", "one", "two words", passage,
        words(rng, 40) + " " + passage + " " + words(rng, 40), words(rng, 30) + "\n" + passage, "é" * 700, "a" * 900,
        "a" * 900 + "b", "Ünï 漢字 \x85 　 x" * 60, words(rng, 12), words(rng, 13), words(rng, 13),
        words(rng, 60_000, 5_000), base[:500] + words(rng, 20), "it's they'll 'd <|endoftext|> 12 3",
    ]


def documents(spark, texts, extra=False, ids=None):
    ids = ids or list(range(len(texts)))
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in zip(ids, texts)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    if extra:  # names the operators use themselves
        from pyspark.sql import functions as F

        for name in ("chunk", "key", "rest", "fp", "slice", "guest", "place", "_none", "_hash", "_p_toxic", "p_toxic", "n_tokens", "score"):
            df = df.withColumn(name, F.lit("x"))
    return df


def as_dict(df, key="doc_id"):
    return {r[key]: r.asDict(True) for r in df.collect()}
