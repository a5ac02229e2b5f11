"""Small document tables for the operators' tests."""

from __future__ import annotations

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, host string, keys string, kept string, token string"

#: nulls, empty and blank texts, repeated rows, no letters, a very long text, ties; extra columns with clashing names
LONG = ("The quick brown fox jumps over the lazy dog number %d. " * 1) % 1 + " ".join(f"word{i % 977}" for i in range(40_000))
ROWS = [
    (1, "The house is on the hill and the river is near.\nShared line", "en"),
    (2, "The house is on the hill and the river is near.\nShared line", "en"),
    (2, "The house is on the hill and the river is near.\nShared line", "en"),
    (3, None, "en"),
    (4, "", None),
    (5, "   \n\t ", "de"),
    (6, "12345 --- !!!", None),
    (7, "Das Haus steht auf dem Berg und der Fluss ist nah.\nShared line", "de"),
    (8, LONG, "en"),
    (None, "A row without an id.", "en"),
    (9, "é", "fr"),
    (10, "x", None),
]


def documents(spark, rows=None):
    rows = ROWS if rows is None else rows
    return spark.createDataFrame([(i, t, l, "s", None, "9", "h", "k", "no", "t") for i, t, l in rows], SCHEMA)


def empty(spark):
    return documents(spark).where("false")
