"""Rows that every operator has to bear, and readers of the small tables."""

from pyspark.sql import functions as F

LONG = "word " * 40_000 + "end"
ODD = [
    (1, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda."),
    (2, None),
    (3, ""),
    (4, " \n\t "),
    (5, LONG),
    (6, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda."),
    (6, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda."),
    (7, "Ünïcödé 日本語 😀 ▁ \x00 text"),
    (None, "A row without an id, but with enough words to count as a text here."),
    (None, None),
    (8, "one"),
]
#: Names that operators use inside; a table may have them too.
CLASHING = ["fp", "row", "component", "first", "n", "kind", "key", "anchor", "mention", "rate", "copies", "symbols", "_m", "_row", "n_entities", "y", "w"]


def odd(spark, extra=True):
    df = spark.createDataFrame(ODD, "doc_id long, text string")
    return df.withColumns({c: F.lit(7) for c in CLASHING}) if extra else df


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def labels(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


def words(text):
    return (text or "").encode("utf-8", "surrogatepass").split()


def table(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")
