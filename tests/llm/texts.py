"""Small tables with the odd rows that every operator must take, and plain counterparts of the operators."""

import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
# columns named like ones that operators make themselves
CLASHING = ("row", "size", "shard", "spans", "kept", "n_words", "component_id", "label", "node", "k1", "part", "score", "token_ids", "__words")
LONG = " ".join(f"w{i % 977}x{i}" for i in range(30_000))


def words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def prose(seed, n=120, vocabulary=400):
    rng = random.Random(seed)
    return " ".join(rng.choice(["alpha", "beta", "of", "the"]) + str(rng.randrange(vocabulary)) for _ in range(n))


def odd_rows():
    """Nulls, empty and long texts, ties and repeated rows."""
    base = prose(1)
    return [
        (1, base, "en", "a", 1), (2, base, "en", "a", 1), (2, base, "en", "a", 1), (3, None, None, None, None), (4, "", "en", "", 0),
        (5, " \n\t ", "fr", "b", 4), (6, "one", "en", "c", 3), (7, "one two", "en", "c", 7), (8, "ONE two", "en", "c", 7),
        (None, base + " tail", "en", "a", 5), (None, None, None, None, None), (9, LONG, "en", "d", 9), (10, "x" * 100_000, "en", "d", 9),
        (11, "a " * 20_000, "en", "d", 9), (12, base.replace("alpha", "ALPHA", 1), "en", "a", 1), (13, "é日本 😀 ñ", "es", "z", 7),
        (14, prose(2), "en", "b", 1), (15, prose(2) + " more", "en", "b", 1)]


def odd(spark, clashing=True):
    frame = spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)
    if clashing:
        for name in CLASHING:
            from pyspark.sql import functions as F

            frame = frame.withColumn(name, F.lit("own"))
    return frame


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
