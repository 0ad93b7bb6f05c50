"""A table whose extra columns bear names that operators might use."""

import pytest

CLASH = "doc_id long, text string, lang string, source string, n_chars long, epoch string, whole string, cut string, mix_tokens string, confidence string, Identified_Lang string, text_lang string, fingerprint string, __p string, __text string"


@pytest.fixture(scope="module")
def clash(spark):
    rows = [(i, f"some words of text number {i}. " * (1 + i % 3), "en", f"s{i % 2}", 9, *("kept" for _ in range(10))) for i in range(12)]
    return spark.createDataFrame(rows, CLASH)
