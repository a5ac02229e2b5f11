"""Query op2: site-relative boilerplate lines dropped from all documents, the source as host."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import read
from .lines import MAX_RATIO, MIN_PAGES, drop_boilerplate


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_boilerplate(read(spark, sf_dir, "documents"))


SQL = f"""
WITH lines AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL
), totals AS (
  SELECT source, count(*) AS n_pages FROM documents GROUP BY source
), held AS (
  SELECT source, line, count(*) AS n_held
  FROM (SELECT DISTINCT doc_id, source, line FROM lines WHERE trim(line, ' ') <> '')
  GROUP BY source, line
), often AS (
  SELECT h.source, list(h.line) AS boiler
  FROM held h JOIN totals t ON h.source IS NOT DISTINCT FROM t.source
  WHERE h.n_held >= {MIN_PAGES} AND h.n_held > {MAX_RATIO} * t.n_pages
  GROUP BY h.source
), cut AS (
  SELECT d.doc_id, d.source AS host, string_split(d.text, chr(10)) AS parts,
         list_filter(string_split(d.text, chr(10)), lambda x: NOT coalesce(list_contains(o.boiler, x), false)) AS kept
  FROM documents d LEFT JOIN often o ON d.source IS NOT DISTINCT FROM o.source
)
SELECT doc_id, host, array_to_string(kept, chr(10)) AS text,
       CAST(coalesce(len(parts), 0) AS BIGINT) AS n_lines,
       CAST(coalesce(len(parts) - len(kept), 0) AS BIGINT) AS n_removed
FROM cut
"""

QUERIES = {"op2_line_dedup": op2_line_dedup}
ORACLES = {"op2_line_dedup": SQL}
