import os

import pytest

SMOKE = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, slot int, shard string, rate double, score double, d int, key long, _lower string"


@pytest.fixture(scope="session")
def tables():
    def load(spark, name):
        return spark.read.parquet(f"{SMOKE}/{name}.parquet")
    return load


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns named like the operators' own."""
    line = "a line of some length that many documents share"
    texts = [(1, None), (2, ""), (3, "   \n\t"), (4, f"{line}\nown words of the fourth text"), (5, f"{line}\nfifth"), (6, f" {line.upper()} \nsixth"),
             (7, " ".join(f"w{i % 977}x{i}" for i in range(60_000))), (8, "x" * 300_000), (9, "same words here for both of them"), (9, "same words here for both of them"),
             (None, "no id, some words"), (None, None), (10, "Same words, here: for both of THEM")]
    rows = [(i, t, None if k % 3 else "en", None if k % 4 else "src0", None, 1, "s", 0.5, 0.1, 3, 4, "z") for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, COLUMNS)


@pytest.fixture(scope="session")
def empty(spark, odd):
    return spark.createDataFrame([], odd.schema)


os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
