import random

import pytest

WORDS = "the of and to in is was that river stone garden letter window market winter summer bridge doctor teacher signal paper morning engine forest island history music number village".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    words = [r.choice(WORDS) + (r.choice("abcdefgh") * r.randrange(3) if r.random() < 0.4 else "") for _ in range(n)]
    return " ".join(w + (".\n" if i % 17 == 16 else "") for i, w in enumerate(words)).replace("\n ", "\n")


def edge_rows():
    """(doc_id, text, source, lang): nulls, empty, blank, short and long texts, exact and near
    copies, repeated rows, equal ids with different texts."""
    base, long = prose(1, 300), prose(2, 6000)
    near = base.split(" ")
    near[150] = "changed"
    return [
        (7, base, "a", "en"), (3, base, "b", "en"), (12, " ".join(near), None, None), (5, prose(3, 120), "a", "de"),
        (9, "", "a", "en"), (10, None, "c", "en"), (11, " \n\t ", "c", None), (20, "one two", "a", "en"), (21, "One  TWO", "a", "en"),
        (22, "ab cd ef gh", "a", "en"), (30, long, "b", "en"), (31, "x" * 5000, "b", "en"), (32, "ab " * 900, "b", "en"),
        (40, prose(4, 80), "a", "en"), (40, prose(4, 80), "a", "en"), (41, prose(5, 90), "a", "en"), (41, prose(6, 90), "a", "en"),
        (None, base, "a", "en"), (None, None, None, None), (50, "é ü ß 日本 " * 40, "é", "de"), (51, "<|endoftext|> a<|endoftext|>b", "a", "en"),
        (60, base[:700] + prose(7, 100), "a", "en"), (61, prose(8, 40) + base[300:900], "a", "en"),
    ]


SCHEMA = "doc_id long, text string, source string, lang string"
#: Names the operators use inside.
CLASHES = "key chunk node label n bucket row size target epochs taken before offset first h_hot __times __id __gone __copy l_id x".split()


@pytest.fixture(scope="session")
def edge_docs(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(edge_rows(), SCHEMA).repartition(4)
    return df.select("*", *[F.lit("clash").alias(c) for c in CLASHES])


@pytest.fixture(scope="session")
def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def small_docs(spark, sf_dir):
    return [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]
