"""Small tables with the odd cases every operator must define, and helpers."""

import random

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "sea stone " * 30_000
ODD_TEXTS = [
    None, "", " ", "\n\n", "word", "word", "ä ö ü ß Σς", "a\tb  c\n\nd ", "日本語 テキスト 😀", "\x00\x01 x\x01, y", "it's we've I'LL 'tis", "1234 ... !!",
    "<|endoftext|> and <|startoftext|> inside", "é é ﬁ İ", "x" * 5000, LONG]


def odd_documents(spark):
    """Null ids, repeated rows and ids, ties, empty and very long texts."""
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(ODD_TEXTS)]
    rows += [rows[7], rows[7], *((i, t, None, "s", len(t)) for i, t in ((7, "other text under a used id"), (None, "text without id"), (-5, "negative id")))]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def documents(spark, texts):
    return spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], SCHEMA)


def clashing(df):
    """The table with further columns named like results and helpers."""
    from pyspark.sql import functions as F

    names = ("node", "label", "key", "shard", "part", "k", "h", "x", "score", "n_tokens", "own", "ids")
    return df.withColumns({n: F.lit("clash") for n in names})


def rows(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=repr)


def as_dicts(df) -> list[dict]:
    return [r.asDict() for r in df.collect()]


def random_texts(seed: int, n: int, parts: list[str], most: int) -> list[str]:
    r = random.Random(seed)
    return ["".join(r.choice(parts) for _ in range(r.randint(0, most))) for _ in range(n)]

