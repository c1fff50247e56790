"""Fixtures for the corpus operators: a small table with hard cases, and its shared folder."""

import pytest
from pyspark.sql import types as T

LONG = " ".join(f"w{i}" for i in range(30_000))
TEXTS = {
    0: "the quick brown fox jumps over the lazy dog again and again\nshared line of nine plain words stands right here\n",
    1: "the quick brown fox jumps over the lazy dog again and again\nshared line of nine plain words stands right here\n",
    2: "shared line of nine plain words stood right here\nother",
    3: "",
    4: None,
    5: "   \n\t\n",
    6: LONG,
    7: LONG + " end",
    8: "short one",
    9: "short one",
    10: "a b c d",
    11: "write to anna@mail.example.com or +1 (244) 555-4688, card 4111 1111 1111 1111, ip 10.0.0.1",
    12: "ünïcödé 漢字 😀 text\r\nwith spaces\x1f and\x85 breaks",
    13: "x" * 50_000,
}
SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
])
EXTRA = ["size", "score", "shard", "slot", "ids", "spans", "lines", "n", "doc", "a", "component", "rate", "copies", "part"]
EXTRA += ["_source", "_copy", "_text", "_doc", "_version", "_packed", "_of", "_in", "_numbers"]


@pytest.fixture(scope="session", autouse=True)
def shared(spark, tmp_path_factory):
    """The shared folder; a cluster names it in ``spark.checkpoint.dir``."""
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))


def rows():
    out = [(i, t, "en", ("a", "b", None)[i % 3], len(t or "")) for i, t in TEXTS.items()]
    return [*out, out[0], (None, "no id " * 8, None, "b", None), (None, None, None, None, None)]


@pytest.fixture(scope="session")
def documents(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(documents):
    """Extra columns with names that the operators use."""
    from pyspark.sql import functions as F

    return documents.select("*", *(F.lit("kept").alias(c) for c in EXTRA))
