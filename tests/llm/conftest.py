"""Small documents that hold every awkward case: nulls, empty and very long texts, ties, repeats, clashing column names."""

import pytest
from pyspark.sql import types as T

WORDS = "the quick brown fox jumps over one lazy dog while seven quiet painters count bright copper kettles near old harbour walls".split()


def prose(n, seed):
    x, out = seed * 7919 + 1, []
    for _ in range(n):
        x = (x * 48271) % 2147483647
        out.append(WORDS[x % len(WORDS)] + ("" if x % 5 else str(x % 97)))
    return " ".join(out)


ROWS = [
    (1, prose(60, 1), "en"),
    (2, None, "en"),
    (3, "", None),
    (4, prose(60, 1), "en"),  # equal to 1
    (5, prose(60, 1).replace("fox", "cat", 1) + "\n" + prose(20, 9), "de"),
    (6, prose(20, 9) + "\n" + prose(20, 9).upper() + "\nshort", None),
    (7, prose(30_000, 3), "en"),  # very long
    (8, " \t\n ", "de"),
    (9, "Ünïcode “quotes” — \U0001f600 \x00 tail space  two", "fr"),
    (10, "12345 !!! 678", "fr"),
    (None, "a row without an id", None),
    (11, "A\r\nb\x0bC\x0cd e", "en"),
    (12, prose(60, 1), "en"),
    (12, prose(60, 1), "en"),  # a repeated row
    (13, "▁ marks ▁▁ and <s> </s> <unk>", "de"),
]
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), *[T.StructField(c, T.StringType()) for c in ("id", "fp", "sha", "h", "node", "label", "size", "a.b")]])


@pytest.fixture(scope="session")
def awkward(spark):
    return spark.createDataFrame([(*r, *["clash"] * 8) for r in ROWS], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
