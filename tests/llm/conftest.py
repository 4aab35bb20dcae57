import random

import pytest
from pyspark.sql import functions as F

#: Names that operators use inside or return, put beside the input's own columns.
CLASHING = ["score", "label", "fingerprint", "fp", "text_key", "component_id", "key", "k", "n", "size", "target", "taken", "copies", "place", "shard", "part", "ghost", "order", "ids", "kept", "features", "labels", "_n", "_text_key", "_copy", "_id"]


def prose(rnd, n):
    return " ".join("".join(rnd.choice(["an", "the", "ou", "ti", "re", "lo", "se"]) for _ in range(rnd.randrange(1, 4))) for _ in range(n))


def odd_rows():
    """(doc_id, text, lang, source, n_chars): nulls in every column, empty, blank, very long and repeated rows."""
    rnd = random.Random(11)
    texts = [None, "", " \t\n ", "one", "é ü▁ x 😀", "a" * 30_000, prose(rnd, 20_000), "!!! ??? ###", "x\n\nx\nx"]
    rows = [(i, t, ["en", None, "fr"][i % 3], [None, "s1", "s0", ""][i % 4], None) for i, t in enumerate(texts)]
    rows += [(100 + i, prose(rnd, rnd.randrange(5, 200)), "en", f"s{i % 3}", 1) for i in range(30)]
    same = prose(rnd, 80)
    rows += [(200 + i, same, "en", "s0", 2) for i in range(5)]
    rows += [(300, "twice the same row here and now", "en", "s1", 3)] * 3
    rows += [(None, "no id at all", None, None, None), (None, None, None, None, None), (None, same, "en", "s2", 4)]
    rows += [(301, "one id", "en", "s1", 3), (301, "two texts", "en", "s1", 3)]
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).withColumns({c: F.lit("x") for c in CLASHING})


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")


SF = "/root/testdata/sf0.01"


@pytest.fixture
def sf():
    return SF


@pytest.fixture
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")
