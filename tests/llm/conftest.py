from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


ODD = [None, "", " ", "\n\n  \n", "a", "Zoë 漢字 😀 ▁x  y", "same text again and again", "same text again and again", "word " * 30_000, "x" * 50_000, "a\tb \n c d  e", "<|endoftext|> in a text"]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, ties and repeated rows, and an extra column with a clashing name."""
    rows = [(None if i == 4 else i, t, None if i % 3 == 0 else "en", None if i % 4 == 0 else "src0", None, i) for i, t in enumerate(ODD)]
    return spark.createDataFrame([*rows, rows[6]], "doc_id long, text string, lang string, source string, n_chars long, score long")


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
