import pytest
from pyspark.sql import functions as F

#: Nulls in any column, empty and long texts, ties and repeated rows, columns with clashing names.
LONG = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
PASSAGE = " ".join(f"common{i}" for i in range(60))
ROWS = [
    (1, "Der Hund und die Katze sind im Garten. " * 3 + PASSAGE, "de"),
    (2, None, "en"),
    (None, "a text without an id but with words in it, some of them long", None),
    (3, "", "en"),
    (4, "!!! 123 ???", "en"),
    (5, "The dog and the cat are in the garden. " * 3, "en"),
    (5, "The dog and the cat are in the garden. " * 3, "en"),
    (6, "The dog and the cat are in the garden. " * 3, "en"),
    (7, LONG, "en"),
    (8, PASSAGE + " tail", "en"),
    (9, "naïve ÉCOLE İstanbul ǰ <|endoftext|> it's 2024", None),
    (10, "GIF89a is not an image, nor is BM or \u0000PK", "en"),
]


@pytest.fixture(scope="session")
def odd(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string")
    # columns that share names with what operators use inside
    for name in ("size", "shard", "nid", "label", "tkey", "h", "n", "part", "unit", "__x"):
        df = df.withColumn(name, F.lit("clash"))
    return df.cache()


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").cache()
