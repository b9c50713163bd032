"""Small tables for the text operators."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
# Names that the operators use for columns of their own.
CLASHING = ["text_key", "id", "name", "component_id", "kept", "llm_x", "n_tokens", "start", "sequence_id", "score", "rep"]


def prose(rng, n_words, vocabulary=400):
    return " ".join(f"w{int(rng.paretovariate(0.7)) % vocabulary}" for _ in range(n_words))


def documents(seed=7, n=60):
    """Texts with copies, near copies, shared passages and lines, repeated content and odd characters."""
    rng = random.Random(seed)
    passage = prose(rng, 70)
    texts = []
    for i in range(n):
        lines = [prose(rng, rng.randint(1, 60)) for _ in range(rng.randint(1, 8))]
        if i % 5 == 0:
            lines.insert(rng.randint(0, len(lines)), passage)
        if i % 7 == 0 and texts:
            words = rng.choice(texts).split(" ")
            for _ in range(max(1, len(words) // 60)):
                words[rng.randrange(len(words))] = f"x{i}"
            lines = " ".join(words).split("\n")
        if i % 11 == 0:
            lines += [lines[0]] * 3
        texts.append("\n".join(lines))
    texts += [texts[3], texts[3], "é" * 130 + "ß" * 200, "ab" * 300, "ab" * 100, " \t\n ", "one two", "One  two", ""]
    return [(i, text, "en", f"s{i % 3}", len(text)) for i, text in enumerate(texts)]


def awkward(long=60_000):
    """Missing values in every column, empty and long texts, ties, and rows that repeat an id, a text or both."""
    rng = random.Random(3)
    text = prose(rng, 90)
    return [
        (1, text, "en", "a", 5),
        (1, text, "en", "a", 5),
        (1, "another text under the same id", None, "a", None),
        (2, text, "en", None, 5),
        (3, None, "en", "a", 0),
        (4, "", None, None, None),
        (None, text, "en", "a", 5),
        (None, None, None, None, None),
        (5, "word " * (long // 5), "en", "a", 5),
        (6, "x" * long, "en", "a", 5),
        (7, prose(rng, long // 4), "en", "a", 5),
        (-8, "tie tie tie tie\ntie tie tie tie\n\ntie", "en", "a", 5),
    ]


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema)


def with_clashes(df):
    from pyspark.sql import functions as F

    return df.withColumns({name: F.lit("clash") for name in CLASHING if name not in df.columns})
