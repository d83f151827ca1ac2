"""Rows with everything that must not crash an operator."""

from __future__ import annotations

import pytest

LONG = " ".join(f"word{k % 977}" for k in range(60_000))
TEXTS = [
    None,
    "",
    " \t\n ",
    "a",
    "One two three four five six seven eight nine ten eleven twelve.",
    "One two three four five six seven eight nine ten eleven twelve.",
    "one two three four five six seven eight nine ten eleven twelve!",
    "the same five words here the same five words here and the same five words here\nline\nline\nline",
    "## $$ %% && | < > " * 20,
    "naïve  café — 日本語 テキスト 😀 \x00\x1f <|endoftext|> <|startoftext|>",
    "x" * 5000,
    "12345 !!! ...",
    LONG,
]


@pytest.fixture(scope="session")
def docs(spark):
    """Documents with null ids, languages and sources, repeated rows and extra columns that clash."""
    rows = [(k, t, "en" if k % 2 else None, "s" if k % 3 else None, len(t or ""), "mine", 1.5, k) for k, t in enumerate(TEXTS)]
    rows += [rows[4], rows[4], (None, "no id at all", "en", "s", 12, "mine", None, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, lang_pred string, score double, n_tokens int"
    return spark.createDataFrame(rows, schema).withColumnsRenamed({}).selectExpr("*", "'x' as kept", "named_struct('a', 1) as _quality", "1 as ids", "2 as t", "3 as q")


@pytest.fixture(scope="session")
def nothing(docs):
    return docs.where("false")
