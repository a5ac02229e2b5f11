"""Query op3: known licence texts in all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import read
from .licenses import COPYRIGHT, KNOWN, SEVERAL_LINES, SPELLINGS, TEXTS, WHOLE_TEXTS, known_digests, scan


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document and licence found in it; null and empty texts match nothing, repeated ids are summed.
    An empty table gives an empty one; other columns are ignored."""
    return scan(read(spark, sf_dir, "documents"), known_digests(spark))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _canonical(column: str) -> str:
    out = f"regexp_replace(lower({column}), {_quoted(COPYRIGHT)}, '', 'g')"
    for old, new in SPELLINGS:
        out = f"regexp_replace({out}, {_quoted(old)}, {_quoted(new.replace('$', chr(92)))}, 'g')"
    return f"regexp_replace({out}, '[^\\p{{L}}\\p{{N}}\\n]+', ' ', 'g')"


def _flat(column: str) -> str:
    return f"trim(regexp_replace({column}, '[ \\n]+', ' ', 'g'), ' ')"


SQL = f"""
WITH known(license_id, text) AS (VALUES {", ".join(f"({_quoted(i)}, {_quoted(x)})" for i, x in KNOWN + TEXTS)}),
digests AS (
  SELECT digest, min(license_id) AS license_id FROM (
    SELECT md5({_flat(_canonical("text"))}) AS digest, license_id FROM known
    UNION ALL VALUES {", ".join(f"({_quoted(d)}, {_quoted(i)})" for i, d in WHOLE_TEXTS)}
  ) GROUP BY digest
), lines AS (
  SELECT doc_id, {_canonical("text")} AS lines FROM documents WHERE text IS NOT NULL
), units AS (
  SELECT doc_id, 'whole' AS kind, {_flat("lines")} AS body FROM lines
  UNION ALL
  SELECT doc_id, 'paragraph', {_flat("part")} FROM (SELECT doc_id, unnest(string_split_regex(lines, '\n *\n')) AS part FROM lines)
  WHERE regexp_matches(part, {_quoted(SEVERAL_LINES)})
  UNION ALL
  SELECT doc_id, 'line', trim(unnest(string_split(lines, chr(10))), ' ') FROM lines
)
SELECT doc_id, license_id, bool_or(kind = 'whole') AS whole_text, count(*) FILTER (kind = 'paragraph') AS n_paragraphs,
       count(*) FILTER (kind = 'line') AS n_lines
FROM units JOIN digests ON md5(body) = digest WHERE body <> ''
GROUP BY doc_id, license_id
"""

QUERIES = {"op3_license_scan": op3_license_scan}
ORACLES = {"op3_license_scan": SQL}
