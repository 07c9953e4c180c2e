"""Fixtures shared by the operator tests: odd rows and brute-force words."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")

ODD_TEXTS = [
    None,
    "",
    " \n\t ",
    "one",
    "Two words",
    "café naïve 日本語 \U0001f600!! áb̌",
    "mail a.b+c@x-y.example.org, +1 (555) 010-0000; 4111 1111 1111 1111 at 10.0.0.1.\nline\nline",
    "x" * 5000,
    "word " * 3000,
]


def doc_rows(texts):
    """Rows for texts, with repeated rows, a null id and an extra, clashing column."""
    rows = [(i, t, "en", f"src{i % 3}", len(t or ""), "clash") for i, t in enumerate(texts)]
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, queue string"


def docs_frame(spark, texts):
    return spark.createDataFrame(doc_rows(texts), SCHEMA)


def words(text):
    return WORD.findall(text or "")
