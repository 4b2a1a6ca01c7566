"""Rows with everything that may come: nulls, empty and very long texts, ties,
repeated rows, and columns whose names an operator might use itself."""

from pyspark.sql import types as T

SF_SMALL = "/root/testdata/sf0.001"

LONG = "Der lange Text hat viele Worte und noch mehr. " * 4000
ROWS = [
    (1, "The first text of the table has a few words.", "en", "a", 1, "k1"),
    (2, None, "en", None, None, None),
    (3, "", None, "a", 0, "k3"),
    (4, "The first text of the table has a few words.", "en", "b", 1, "k4"),
    (4, "The first text of the table has a few words.", "en", "b", 1, "k4"),
    (None, "A row without a number, but with words.", "en", "c", 1, None),
    (None, None, None, None, None, None),
    (7, LONG, "de", "c", 1, "k7"),
    (8, "12 345 !!! 678", None, "c", 1, "k8"),
    (9, "Größe \U0001f389 日本語 naïve\x00 \t\n  end ", "de", "c", 1, "k9"),
    (10, "   ", "fr", "c", 1, "k10"),
    (11, "x" * 9000, "en", "d", 1, "k11"),
]
SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        T.StructField("k", T.StringType()),
    ]
)
CLASH = ["k", "t", "r", "h", "x", "n", "rest", "length", "bucket", "rank", "words", "score", "start", "kept"]


def edge_docs(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA).drop("k")
    for c in CLASH:
        docs = docs.selectExpr("*", f"'{c}' AS `{c}`")
    return docs


def empty_docs(spark):
    return edge_docs(spark).limit(0)


def documents(spark, sf=SF_SMALL):
    return spark.read.parquet(f"{sf}/documents.parquet")
