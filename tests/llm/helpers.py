"""Small tables with everything that a row can do wrong."""

import random
import string

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, tie long, node string, key long,"
          " weight double, row string, value string, shingle string, mix_tokens string")
BASE = "the quick brown fox jumps over the lazy dog near the old river bank at dawn".split()


def prose(n: int, seed: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choices(string.ascii_lowercase[:8], k=rng.randint(1, 6))) for _ in range(n))


LONG = prose(30_000, 1) + " " + "x" * 50_000
ROWS = [
    (1, "Plain text, with words.\nAnd a second line.", "en", "a", 5),
    (2, None, None, None, None),
    (3, "", "en", "a", 0),
    (4, " \t\n\x0b ", "en", "b", 5),
    (5, LONG, "de", "a", None),
    (6, "Plain text, with words.\nAnd a second line.", "fr", "b", 5),    # the text of 1
    (7, "word", "en", "a", 4),
    (8, "éè 你好 \U0001F600  double  spaces\r\n\ttabs <|endoftext|> don't", "es", "c", 1),
    (9, " ".join(BASE * 6), "en", "a", 1),
    (9, " ".join(BASE * 6), "en", "a", 1),                              # a repeated row
    (10, " ".join(BASE * 6 + ["today"]), "en", "a", 1),
    (None, "a text without an id " + prose(30, 5), "en", "a", 1),
    (-3, "below zero " + prose(40, 6), None, "a", 1),
]


def documents(spark, rows=None):
    rows = ROWS if rows is None else rows
    extra = (7, "n", 1, 0.5, "r", "v", "s", "t")
    return spark.createDataFrame([tuple(r) + extra for r in rows], SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
