import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the of and to in stone river cloud über naïve café 7x 42 Log line error warn open close Red blue".split()


def some_text(rng: random.Random, n: int) -> str:
    out = [rng.choice(WORDS) for _ in range(n)]
    return "".join(w + rng.choice([" ", " ", " ", "  ", "\n", ", ", "\t"]) for w in out)


@pytest.fixture(scope="session")
def odd_rows():
    """Documents with nulls, empty, long and equal texts, near copies and repeated rows."""
    rng = random.Random(5)
    texts = [some_text(rng, rng.randint(0, 90)) for _ in range(40)]
    texts += [None, "", "", " ", "x", "é", None, texts[0], texts[0], texts[3], texts[3] + " end", texts[5].replace("the", "one")]
    texts += [texts[7] + texts[8] + texts[9], "zz " * 400, some_text(rng, 4000), "\x00 nul \\ # < : ### </turn>\n"]
    rows = [(i * 3 + 1, t, [None, "en", "de"][i % 3], "src0", None) for i, t in enumerate(texts)]
    return [*rows, rows[2], rows[2], (None, texts[1], "en", None, 1), (None, None, None, None, None)]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    """The rows with columns whose names clash with those that operators make."""
    from pyspark.sql import functions as F

    extra = ["id", "key", "row", "kept", "score", "doc", "spans", "node", "shard", "n", "a", "b", "chunk", "trained", "held_out", "n_bytes", "fingerprint", "line_no", "whole", "text_key"]
    df = spark.createDataFrame(odd_rows, SCHEMA)
    return df.select("*", *[F.lit(7).alias(c) for c in extra]).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
