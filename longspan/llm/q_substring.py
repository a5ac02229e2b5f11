"""Query op8: passages of 20 words or more that repeat across all documents, removed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import read
from .substring import remove_repeats


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row comes back: null and empty texts with no words, rows of one id as one document, rows without an id
    last.  An empty table gives an empty one; other columns are ignored."""
    out = remove_repeats(read(spark, sf_dir, "documents"), window=20, with_text=False)
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256")


SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 19], ' ') AS content FROM w, unnest(range(1, len(ws) - 18)) AS t(i)
), again AS (
  SELECT doc_id, i FROM windows QUALIFY row_number() OVER (PARTITION BY content ORDER BY doc_id, i) > 1
), gone AS (
  SELECT DISTINCT doc_id, i + j AS p FROM again, unnest(range(0, 20)) AS r(j)
), words AS (
  SELECT doc_id, p, ws[p] AS word FROM w, unnest(range(1, len(ws) + 1)) AS t(p)
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS body, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(body, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""

QUERIES = {"op8_substring_dedup": op8_substring_dedup}
ORACLES = {"op8_substring_dedup": SQL}
