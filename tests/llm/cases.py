"""Small tables with the odd rows that every operator has to bear."""

from __future__ import annotations

SCHEMA = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint, fp bigint, text_key string, "
    "ids string, _row int, gram string, block string, score string, path int, _doc_id bigint, _text_key bigint, length int"
)


def documents(spark, rows):
    """(doc_id, text, lang) rows with further columns whose names operators use inside."""
    full = [(i, t, l, "s", None if t is None else len(t), 1, "k", "i", 2, "g", "b", "x", 3, 4, 5, 6) for i, t, l in rows]
    return spark.createDataFrame(full, SCHEMA)


LONG = "the quick brown fox jumps over the lazy dog again and again while the band plays on " * 4000

#: Nulls, empties, white space only, no letters, a very long text, ties and repeated rows.
ODD = [
    (1, None, "en"),
    (2, "", "en"),
    (3, " \t\n", None),
    (4, "12 34 !?", "en"),
    (5, LONG, "en"),
    (6, "a plain short text of some words", "en"),
    (6, "a plain short text of some words", "en"),
    (None, "a row without a number", "de"),
    (None, None, None),
    (7, "line one\nline one\nline two é中😀́", "fr"),
    (8, "x" * 70_000, "en"),
]
