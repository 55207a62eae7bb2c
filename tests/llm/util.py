"""Rows and brute-force helpers for the tests of the training-data operators."""

import re

from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                       T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
SF = "/root/testdata/sf0.001"
BASE = "The quick brown fox jumps over the lazy dog while seven wizards brew a rather strong potion in the old stone tower near the sea"


def frame(spark, rows):
    """rows: (doc_id, text[, lang[, source]])."""
    full = [(*r, *(["en", "a"][len(r) - 2:]), len(r[1]) if r[1] is not None else None) for r in rows]
    return spark.createDataFrame(full, SCHEMA)


def odd_rows():
    """Nulls, empty and blank texts, a very long one, repeated rows and ties."""
    return [(1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "a " * 30000 + "b"), (6, BASE), (6, BASE), (None, BASE), (8, BASE, None, None),
            (9, "Été à Σίσυφος ΟΔΟΣ ẞ İi 123 'll don't $$$ <|endoftext|>x", "fr", "b"), (10, "x\ny\nx\n\nx y\n", "en", "c")]


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def rows_of(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)
