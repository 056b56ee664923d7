from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

LONG = " ".join(f"word{i % 977} of{i % 13}" for i in range(30_000))
SHARED = "The same Passage stands in many documents here, word for word."

#: (doc_id, text): nulls, empties, blanks, long texts, copies, repeated rows.
EDGES = [
    (1, "alpha beta gamma delta\n" + SHARED + "\nepsilon"),
    (2, "  " + SHARED.upper() + "\t\r\nepsilon"),
    (3, None),
    (4, ""),
    (5, " \n\t\n"),
    (6, LONG),
    (7, LONG + "\n" + SHARED),
    (8, "short"),
    (9, "ÉÈ " + SHARED + "\n\n" + SHARED),
    (9, "ÉÈ " + SHARED + "\n\n" + SHARED),
    (10, "日本語 𝒳 \U0001f600 x"),
    (11, "alpha beta gamma delta\n" + SHARED + "\nepsilon"),
    (None, SHARED + "\nno id"),
]
#: Names that the operators use inside, as extra columns of the input.
EXTRA = "lang string, source string, d bigint, v bigint, h1 bigint, key string, pos int, runs string, hash string, _row int"
SCHEMA = "doc_id bigint, text string, n_chars bigint, " + EXTRA


@pytest.fixture(scope="session")
def edge_rows():
    return list(EDGES)


@pytest.fixture(scope="session")
def edges(spark):
    rows = [(i, t, None if t is None else len(t), "en", "s", 1, 2, 3, "k", 4, "r", "h", 5) for i, t in EDGES]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
