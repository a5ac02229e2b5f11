"""Named queries over whole tables, each beside the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.tags import TAG_TABLE
from ..operators import chunks, codecs, container, crypto, digests, filters, matches, parse, places, report, suffixes
from ..options import DIGESTS, FILTERS, SUPPORTED, Options
from ..sources.files import as_files, spread, table
from ..streaming.chunks import run_chunks

CHUNK, BLOCK = 4096, 512
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "documents"))


def _files(spark: SparkSession, sf: str) -> DataFrame:
    return as_files(_docs(spark, sf))


# --- repeated text (survey: S1 P1 J1 J2 A1 A2 W4) ---

_GRAMS = """
seg AS (SELECT doc_id, k, substr(text, CAST(k * 256 + 1 AS BIGINT), 286) AS s FROM documents, unnest(range(0, length(text) // 256 + 1)) AS t(k)),
grams AS (SELECT doc_id, CAST(k * 256 + i AS BIGINT) AS pos, substr(s, i, 31) AS gram FROM seg, unnest(range(1, 257)) AS u(i) WHERE length(substr(s, i, 31)) = 31)
"""
_COVERED = f"""
WITH {_GRAMS},
places AS (SELECT doc_id, pos FROM grams QUALIFY row_number() OVER (PARTITION BY gram ORDER BY doc_id, pos) > 1),
steps AS (SELECT doc_id, least(31, coalesce(lead(pos) OVER (PARTITION BY doc_id ORDER BY pos) - pos, 31)) AS step FROM places),
covered AS (SELECT doc_id, sum(step) AS covered_chars FROM steps GROUP BY doc_id),
rows_ AS (SELECT d.doc_id, d.source, d.lang, CAST(length(d.text) AS BIGINT) AS chars, CAST(coalesce(c.covered_chars, 0) AS BIGINT) AS covered_chars
          FROM documents d LEFT JOIN covered c USING (doc_id))
"""


def _covered(spark: SparkSession, sf: str) -> DataFrame:
    docs = _docs(spark, sf)
    covered = matches.coverage(docs)
    sized = docs.select("doc_id", "source", "lang", F.length("text").cast("bigint").alias("chars"))
    return sized.join(covered, "doc_id", "left").withColumn("covered_chars", F.coalesce("covered_chars", F.lit(0)).cast("bigint"))


@_query(_COVERED + "SELECT doc_id, chars, covered_chars, chars - covered_chars AS literal_chars FROM rows_")
def match_coverage(spark, sf):
    return _covered(spark, sf).select("doc_id", "chars", "covered_chars", (F.col("chars") - F.col("covered_chars")).alias("literal_chars"))


_GROUPED = """SELECT {key}, CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(chars) AS BIGINT) AS chars, CAST(sum(covered_chars) AS BIGINT) AS covered_chars,
round(sum(covered_chars) * 1.0 / sum(chars), 9) AS share FROM rows_ GROUP BY {key}"""


def _grouped(df: DataFrame, key: str) -> DataFrame:
    out = df.groupBy(key).agg(F.count(F.lit(1)).alias("n_docs"), F.sum("chars").alias("chars"), F.sum("covered_chars").alias("covered_chars"))
    return out.withColumn("share", F.round(F.col("covered_chars") / F.col("chars"), 9))


@_query(_COVERED + _GROUPED.format(key="source"))
def match_coverage_by_source(spark, sf):
    return _grouped(_covered(spark, sf), "source")


@_query(_COVERED + _GROUPED.format(key="lang"))
def redundancy_by_lang(spark, sf):
    return _grouped(_covered(spark, sf), "lang")


@_query(f"""
WITH {_GRAMS},
pairs AS (SELECT doc_id, pos, lag(doc_id) OVER w AS source_doc, lag(pos) OVER w AS source_pos FROM grams WINDOW w AS (PARTITION BY gram ORDER BY doc_id, pos)),
runs AS (SELECT *, pos - source_pos AS diagonal, pos - row_number() OVER (PARTITION BY doc_id, source_doc, pos - source_pos ORDER BY pos) AS run FROM pairs WHERE source_doc IS NOT NULL)
SELECT doc_id, min(pos) AS pos, source_doc, min(source_pos) AS source_pos, CAST(count(*) + 30 AS BIGINT) AS length
FROM runs GROUP BY doc_id, source_doc, diagonal, run
""")
def match_runs(spark, sf):
    return matches.match_runs(_docs(spark, sf))


@_query("""
WITH b AS (SELECT item_id, substr(text, i, 31) AS gram FROM benchmark, unnest(range(1, length(text) + 1)) AS u(i) WHERE length(substr(text, i, 31)) = 31),
""" + _GRAMS.strip() + """
SELECT g.doc_id, b.item_id AS source_doc, count(*) AS anchors
FROM (SELECT DISTINCT doc_id, gram FROM grams) g JOIN (SELECT DISTINCT item_id, gram FROM b) b USING (gram) GROUP BY 1, 2
""")
def global_matches(spark, sf):
    items = table(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    return matches.anchor_matches(_docs(spark, sf), items, bits=0)


# --- chunks and block duplicates (S1 T2 F13 A8 H2 H4 P6) ---

_CUT = """
SELECT CAST(doc_id AS VARCHAR) AS archive_id, CAST(k AS INTEGER) AS chunk_no, CAST(k * {size} AS BIGINT) AS "offset",
CAST(least({size}, n - k * {size}) AS BIGINT) AS chunk_size, k = (n - 1) // {size} OR n = 0 AS eof,
from_hex(substr(h, CAST(k * {size} * 2 + 1 AS BIGINT), {size} * 2)) AS data
FROM (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents), unnest(range(0, greatest((n - 1) // {size}, 0) + 1)) AS t(k)
"""


@_query(f"""SELECT archive_id, chunk_no, "offset", chunk_size, CAST(ceil(length(bin(chunk_size)) / 8.0) AS INTEGER) AS chunk_bytes, eof, md5(data) AS digest FROM ({_CUT.format(size=CHUNK)})""")
def chunk_plan(spark, sf):
    return chunks.cut(_files(spark, sf), CHUNK).withColumn("digest", F.md5("data")).drop("data")


@_query(ORACLES["chunk_plan"])
def stream_chunks(spark, sf):
    return run_chunks(spark, f"{sf}/documents.parquet", CHUNK)


def _dups(name: str):
    return f"""SELECT archive_id, chunk_no, CAST(octet_length(data) AS INTEGER) AS u_len, {name}(data) AS digest,
count(*) OVER (PARTITION BY {name}(data)) AS copies, CAST(row_number() OVER (PARTITION BY {name}(data) ORDER BY archive_id, chunk_no) AS INTEGER) AS copy_no FROM ({_CUT.format(size=BLOCK)})"""


@_query(_dups("md5"))
def dup_blocks_md5(spark, sf):
    return chunks.numbered_copies(chunks.cut(_files(spark, sf), BLOCK), F.md5("data"), ["archive_id", "chunk_no"])


@_query(_dups("sha256"))
def dup_blocks_sha256(spark, sf):
    return chunks.numbered_copies(chunks.cut(_files(spark, sf), BLOCK), F.sha2("data", 256), ["archive_id", "chunk_no"])


@_query(f"""SELECT md5(data) AS digest, min(struct_pack(a := archive_id, c := chunk_no)).a AS archive_id, min(struct_pack(a := archive_id, c := chunk_no)).c AS chunk_no,
count(*) AS copies, CAST(min(octet_length(data)) AS BIGINT) AS u_len FROM ({_CUT.format(size=BLOCK)}) GROUP BY 1""")
def first_seen_block(spark, sf):
    return chunks.first_seen(chunks.cut(_files(spark, sf), BLOCK), F.md5("data"), ["archive_id", "chunk_no"])


@_query(f"""
WITH b AS (SELECT d.lang, md5(c.data) AS digest, octet_length(c.data) AS n FROM ({_CUT.format(size=BLOCK)}) c JOIN documents d ON c.archive_id = CAST(d.doc_id AS VARCHAR)),
u AS (SELECT lang, digest, max(n) AS n, sum(n) AS total FROM b GROUP BY lang, digest)
SELECT lang, CAST(sum(total) AS BIGINT) AS total_bytes, CAST(sum(n) AS BIGINT) AS unique_bytes, round(sum(total) * 1.0 / sum(n), 9) AS dedup_ratio FROM u GROUP BY lang
""")
def dedup_ratio_by_lang(spark, sf):
    files = _docs(spark, sf).select(F.col("doc_id").cast("string").alias("archive_id"), "lang", F.coalesce("text", F.lit("")).cast("binary").alias("data"))
    cut = chunks.cut(files, BLOCK, also=("lang",)).select("lang", F.md5("data").alias("digest"), "chunk_size")
    unique = cut.groupBy("lang", "digest").agg(F.max("chunk_size").alias("n"), F.sum("chunk_size").alias("total"))
    out = unique.groupBy("lang").agg(F.sum("total").alias("total_bytes"), F.sum("n").alias("unique_bytes"))
    return out.withColumn("dedup_ratio", F.round(F.col("total_bytes") / F.col("unique_bytes"), 9))


# --- bytes, tags, delta (P1 P2 P3 W1 W2 W3 W5 O5) ---

_BYTES = """
hexed AS (SELECT item_id, hex(encode(text)) AS h FROM benchmark),
b AS (SELECT item_id, i AS pos, CAST('0x' || substr(h, CAST(2 * i + 1 AS BIGINT), 2) AS INTEGER) AS byte FROM hexed, unnest(range(0, length(h) // 2)) AS u(i))
"""
_TAGS = f"""
WITH {_BYTES.strip()},
t AS (SELECT item_id, pos, bit_xor(([{", ".join(map(str, TAG_TABLE))}])[byte + 1]) OVER w AS tag, count(*) OVER w AS n FROM b
      WINDOW w AS (PARTITION BY item_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 30 FOLLOWING))
"""


def _bytes(spark: SparkSession, sf: str, source: str, key: str) -> DataFrame:
    rows = table(spark, sf, source)
    return (spread(rows) if source == "documents" else rows).select(key, F.col("text").cast("binary").alias("data"))


def _byte_query(sql: str):
    """Registers a query over ``benchmark`` beside its SQL, and over all ``documents`` (tested by brute force: too large for the SQL)."""

    def add(f):
        def items(spark, sf):
            return f(spark, sf, "benchmark", "item_id")

        def documents(spark, sf):
            return f(spark, sf, "documents", "doc_id")

        QUERIES[f.__name__], QUERIES[f"{f.__name__}_documents"] = items, documents
        ORACLES[f.__name__] = sql
        return f

    return add


@_byte_query(_TAGS + "SELECT item_id, pos, CAST(tag AS BIGINT) AS tag FROM t WHERE n = 31")
def rolling_tag(spark, sf, source, key):
    return places.tag_rows(_bytes(spark, sf, source, key), key)


@_byte_query(_TAGS + "SELECT item_id, pos, CAST(tag AS BIGINT) AS tag FROM t WHERE n = 31 AND (tag & 15) = 15")
def sampled_anchors(spark, sf, source, key):
    return places.tag_rows(_bytes(spark, sf, source, key), key, bits=4)


@_byte_query(_TAGS + "SELECT item_id, count(DISTINCT tag) AS total, count(DISTINCT tag & 255) AS first_places, round(count(DISTINCT tag & 255) * 1.0 / count(DISTINCT tag), 9) AS share FROM t WHERE n = 31 GROUP BY item_id")
def anchor_occupancy(spark, sf, source, key):
    """Different tags, and how many of them a table of 256 places would hold at their first place."""
    out = places.tag_sets(_bytes(spark, sf, source, key), key)
    return out.withColumn("share", F.round(F.col("first_places") / F.col("total"), 9))


@_byte_query(_TAGS + "SELECT item_id, bits, count(*) AS places, count(*) FILTER ((tag & ((1 << bits) - 1)) = (1 << bits) - 1) AS anchors FROM t, (VALUES (1), (2), (4), (6)) AS m(bits) WHERE n = 31 GROUP BY 1, 2")
def anchor_density(spark, sf, source, key):
    return places.tag_density(_bytes(spark, sf, source, key), key)


_DELTA = f"""WITH {_BYTES.strip()},
e AS (SELECT item_id, pos, byte, (byte - coalesce(lag(byte, 4) OVER (PARTITION BY item_id ORDER BY pos), 0) + 256) % 256 AS coded FROM b)
"""


@_byte_query(_DELTA + "SELECT item_id, pos, CAST(coded AS INTEGER) AS coded FROM e")
def delta_encode(spark, sf, source, key):
    return places.delta_rows(_bytes(spark, sf, source, key), key)


@_byte_query(f"WITH {_BYTES.strip()} SELECT item_id, pos, byte AS decoded FROM b")
def delta_decode(spark, sf, source, key):
    return places.undelta_rows(_bytes(spark, sf, source, key), key)


@_byte_query(f"WITH {_BYTES.strip()} SELECT item_id, count(*) AS n_bytes, true AS same FROM b GROUP BY item_id")
def delta_roundtrip(spark, sf, source, key):
    return places.delta_returns(_bytes(spark, sf, source, key), key)


_GAPS = f"WITH {_BYTES.strip()}, g AS (SELECT pos - lag(pos) OVER (PARTITION BY item_id, byte ORDER BY pos) AS gap FROM b), c AS (SELECT gap, count(*) AS n FROM g WHERE gap < 4096 GROUP BY gap) "


@_byte_query(_GAPS + "SELECT gap, n FROM c")
def byte_gap_histogram(spark, sf, source, key):
    return places.byte_gaps(_bytes(spark, sf, source, key), key)


@_byte_query(_GAPS + "SELECT gap, n FROM c ORDER BY n DESC, gap LIMIT 2")
def top_periods(spark, sf, source, key):
    return places.byte_gaps(_bytes(spark, sf, source, key), key).orderBy(F.desc("n"), "gap").limit(2)


# --- scalar rules (F1-F17, Z2, Z3) ---

_LEVELS = "(SELECT CAST(level AS BIGINT) AS level FROM range(1, 10) AS r(level))"
_DICT = "CASE WHEN level < 4 THEN 1 << (2 * level + 16) WHEN level < 7 THEN 1 << (level + 19) ELSE 1 << (level + 18) END"


@_query(f"SELECT level, CAST({_DICT} AS BIGINT) AS dictionary FROM {_LEVELS}")
def dict_size_by_level(spark, sf):
    return spark.range(1, 10).select(F.col("id").alias("level"), S.dictionary_bytes(F.col("id")).cast("bigint").alias("dictionary"))


@_query(f"""
WITH l AS (SELECT level, CAST({_DICT} AS BIGINT) AS dict, CASE WHEN level < 4 THEN 4 WHEN level = 4 THEN 5 ELSE level END AS bs, CAST(floor(level * 5 / 9.0 + 0.5) AS BIGINT) AS zl FROM {_LEVELS})
SELECT level, 'lzma' AS method, CAST(dict * 23 // 2 + 6 * 1048576 + 16384 AS BIGINT) AS overhead FROM l
UNION ALL SELECT level, 'zpaq', CAST(((1 << bs) + CASE zl WHEN 1 THEN 128 WHEN 2 THEN 450 WHEN 3 THEN 450 WHEN 4 THEN 550 ELSE 850 END) * 1048576 AS BIGINT) FROM l
UNION ALL SELECT level, 'bzip3', CAST(CASE WHEN level = 9 THEN 535822336 ELSE (2 + (level - 1) % 2) << ((level - 1) // 2 + 24) END AS BIGINT) * 6 FROM l
UNION ALL SELECT level, 'gzip', 0 FROM l
""")
def overhead_by_level(spark, sf):
    methods = F.explode(F.array(*map(F.lit, ("lzma", "zpaq", "bzip3", "gzip")))).alias("method")
    rows = spark.range(1, 10).select(F.col("id").alias("level"), methods)
    return rows.select("level", "method", S.codec_overhead(F.col("method"), F.col("level")).alias("overhead"))


@_query("SELECT DISTINCT CAST(n AS BIGINT) AS n, CAST(ceil(length(bin(n)) / 8.0) AS INTEGER) AS width FROM (SELECT octet_length(encode(text)) * octet_length(encode(text)) * m AS n FROM documents, (VALUES (CAST(0 AS BIGINT)), (1), (257), (65537)) AS t(m))")
def chunk_byte_width(spark, sf):
    size = F.octet_length("text").cast("bigint")
    n = F.explode(F.transform(F.array(*[F.lit(x).cast("bigint") for x in (0, 1, 257, 65537)]), lambda m: size * size * m)).alias("n")
    return table(spark, sf, "documents").select(n).distinct().select("n", S.byte_width(F.col("n")).alias("width"))


@_query("""SELECT part, whole, CASE WHEN whole < 100 THEN part * 100.0 / CASE WHEN whole = 0 THEN 1 ELSE whole END ELSE CAST(part AS DOUBLE) / (whole // 100) END AS pct
FROM (SELECT CAST(p AS BIGINT) AS part, CAST(w AS BIGINT) AS whole FROM range(0, 400, 7) AS a(p), range(0, 1000, 33) AS b(w))""")
def percentage_fn(spark, sf):
    rows = spark.range(0, 400, 7).select(F.col("id").alias("part")).crossJoin(spark.range(0, 1000, 33).select(F.col("id").alias("whole")))
    return rows.withColumn("pct", S.percentage(F.col("part"), F.col("whole")))


@_query("""SELECT CAST(n AS BIGINT) AS n, greatest(n - n % 4096, 4096) AS page_floor, CAST(ceil(n / 4096.0) * 4096 AS BIGINT) AS page_ceil, CAST(n // 3600 AS BIGINT) AS h, CAST(n % 3600 // 60 AS BIGINT) AS m, CAST(n % 60 AS BIGINT) AS s,
CAST((n & 255) * 16777216 + (n >> 8 & 255) * 65536 + (n >> 16 & 255) * 256 + (n >> 24 & 255) AS BIGINT) AS swapped,
CAST(n % 41 AS BIGINT) AS code, CAST(CASE WHEN n % 41 = 40 THEN 4294967295 ELSE (2 + n % 41 % 2) << (n % 41 // 2 + 11) END AS BIGINT) AS dictionary,
CAST(n % 225 % 9 AS BIGINT) AS lc, CAST(n % 225 // 9 % 5 AS BIGINT) AS lp, CAST(n % 225 // 45 AS BIGINT) AS pb, CAST(CASE WHEN n % 31 + 1 <= 16 THEN n % 31 + 1 ELSE (n % 31 + 1 - 15) * 16 END AS BIGINT) AS delta,
CAST(greatest(floor(256 - (n % 101) * 2.55), 25) AS INTEGER) AS redundancy FROM (SELECT n * 7919 AS n FROM range(0, 3000) AS r(n))""")
def size_rules(spark, sf):
    n = F.col("n")
    h, m, s = S.clock(n)
    lc, lp, pb = S.lzma_properties(n % 225)
    big = lambda c, name: c.cast("bigint").alias(name)
    return spark.range(3000).select((F.col("id") * 7919).alias("n")).select(
        "n", S.page_floor(n).alias("page_floor"), big(S.page_ceil(n), "page_ceil"), big(h, "h"), big(m, "m"), big(s, "s"), big(S.swapped(n, 4), "swapped"),
        big(n % 41, "code"), S.dictionary_of_code(n % 41).alias("dictionary"), big(lc, "lc"), big(lp, "lp"), big(pb, "pb"), big(S.delta_distance(n % 31 + 1), "delta"), S.redundancy(n % 101).alias("redundancy"),
    )


@_query("""SELECT page_id, url || '.lsp' AS packed, CASE WHEN url LIKE '%.lsp' THEN left(url, length(url) - 4) ELSE url || '.out' END AS plain, '/out/' || list_extract(string_split(url, '/'), -1) || '.lsp' AS in_folder FROM pages""")
def name_rules(spark, sf):
    url = F.col("url")
    return table(spark, sf, "pages").select("page_id", S.packed_name(url).alias("packed"), S.unpacked_name(url).alias("plain"), S.packed_name(url, folder="/out").alias("in_folder"))


# --- parse and inverse (2.7, 2.8, A7, J3, J4) ---


@_query(f"SELECT archive_id, chunk_no, chunk_size, true AS roundtrip FROM ({_CUT.format(size=1 << 20)})")
def roundtrip_ok(spark, sf):
    return parse.parse_stats(chunks.cut(_files(spark, sf), 1 << 20)).select("archive_id", "chunk_no", "chunk_size", "roundtrip")


def _by_lang(spark: SparkSession, sf: str) -> DataFrame:
    """All texts of a language and source as one input, in order of the id: windows that span documents."""
    docs = table(spark, sf, "documents").where("text IS NOT NULL")
    grouped = docs.groupBy("source", "lang", F.floor(F.col("doc_id") / 4096).alias("part"))
    rows = grouped.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "text"))), lambda x: x["text"]), "\n").alias("text"))
    return rows.select(F.concat_ws("/", "source", "lang", "part").alias("archive_id"), F.col("text").cast("binary").alias("data"))


@_query()
def parse_stats(spark, sf):
    """Counters by language at level 7, texts joined by source in bounded parts."""
    stats = parse.parse_stats(chunks.cut(_by_lang(spark, sf), 4 << 20))
    return report.token_counters(stats.withColumn("lang", F.element_at(F.split("archive_id", "/"), 2)), "lang")


@_query()
def token_mix(spark, sf):
    """Tokens by kind and size class."""
    tokens = parse.parse_chunks(chunks.cut(_by_lang(spark, sf), 4 << 20))
    return tokens.groupBy("kind", F.floor(F.log2("len")).alias("log2_len")).agg(F.count(F.lit(1)).alias("n"), F.sum("len").alias("bytes"), F.max("distance").alias("farthest"))


# --- codecs and filters (C0-C9, P5-P7, B1-B9) ---

_ONE_ROW_EACH = "SELECT CAST(doc_id AS VARCHAR) AS archive_id, {name} AS {label}, CAST(octet_length(encode(text)) AS INTEGER) AS u_len, md5(text) AS digest FROM documents"


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


@_query(" UNION ALL ".join(_ONE_ROW_EACH.format(name=f"'{m}'", label="method") for m in SUPPORTED))
def codec_roundtrip(spark, sf):
    """Every method over every text, in one pass over the texts."""
    return _each(_files(spark, sf), SUPPORTED, "method", lambda m, x: codecs.decode(m, codecs.encode(m, x), len(x)))


def _each(files: DataFrame, names: tuple[str, ...], label: str, there_and_back) -> DataFrame:
    """``archive_id, label, u_len, digest``: a row for each file and name, with the MD5 of what comes back."""
    import hashlib

    import pyarrow as pa

    def run(batches):
        for batch in batches:
            rows = []
            for key, x in zip(batch.column(0), batch.column(1), strict=True):
                key, x = key.as_py(), x.as_py()
                rows += [(key, name, len(x), hashlib.md5(there_and_back(name, x)).hexdigest()) for name in names]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.int32(), pa.string()), strict=True)], ["archive_id", label, "u_len", "digest"])

    return files.select("archive_id", "data").mapInArrow(run, f"archive_id string, {label} string, u_len int, digest string")


@_query()
def codec_sizes(spark, sf):
    """Packed size by method and level, small blocks stored, each block kept packed only if that is smaller."""
    import pyarrow as pa

    levels = range(1, 10)

    def run(batches):
        total, kept = 0, {m: [0] * len(levels) for m in SUPPORTED[1:]}
        for batch in batches:
            for x in batch.column(1):
                x = x.as_py()
                total += len(x)
                for m, sums in kept.items():
                    sizes = [len(x)] * len(levels) if len(x) < 64 else codecs.sizes_by_level(m, x, levels)
                    kept[m] = [a + min(len(x), b) for a, b in zip(sums, sizes, strict=True)]
        rows = [(m, level, total, c) for m, sums in kept.items() for level, c in zip(levels, sums, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.string(), pa.int32(), pa.int64(), pa.int64()), strict=True)], ["method", "level", "u_len", "c_len"])

    parts = _files(spark, sf).select("archive_id", "data").mapInArrow(run, "method string, level int, u_len bigint, c_len bigint")
    total = parts.groupBy("method", "level").agg(F.sum("u_len").alias("u_len"), F.sum("c_len").alias("c_len"))
    return total.withColumn("ratio", S.ratio(F.col("u_len"), F.col("c_len")))


@_query()
def compressibility_gate(spark, sf):
    """The gate's percentage of each text, and what a ZPAQ coder would be told of it."""
    rows = _files(spark, sf).select("archive_id", F.octet_length("data").alias("u_len"), codecs.gate(F.col("data")).alias("percent"))
    return rows.withColumn("redundancy", S.redundancy(F.col("percent")))


_FILTER_NAMES = [f for f in FILTERS if f != "none"]


@_query(" UNION ALL ".join(_ONE_ROW_EACH.format(name=f"'{m}'", label="filter") for m in _FILTER_NAMES))
def filter_roundtrip(spark, sf):
    """Every filter over every text and back, in one pass over the texts."""
    return _each(_files(spark, sf), tuple(_FILTER_NAMES), "filter", lambda f, x: filters.apply_filter(f, filters.apply_filter(f, x, 4), 4, back=True))


# --- suffix order (O2) ---


@_query("""SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY from_hex(substr(h, CAST(2 * pos + 1 AS BIGINT)))) - 1 AS rank, pos
FROM (SELECT item_id, hex(encode(text)) AS h FROM benchmark), unnest(range(0, length(h) // 2)) AS u(pos)""")
def suffix_order(spark, sf):
    rows = table(spark, sf, "benchmark").select("item_id", F.col("text").cast("binary").alias("data"))
    return suffixes.suffix_rows(rows, "item_id")


@_query(f"""SELECT archive_id, chunk_no, md5(data) AS digest, CAST(octet_length(data) AS BIGINT) AS n FROM ({_CUT.format(size=CHUNK)})""")
def bwt_roundtrip(spark, sf):
    coded = suffixes.bwt_rows(chunks.cut(_files(spark, sf), CHUNK))
    back = suffixes.unbwt_rows(coded)
    return back.select("archive_id", "chunk_no", F.md5("data").alias("digest"), F.octet_length("data").cast("bigint").alias("n"))


# --- containers (S4 S5 S8-S10 A3-A6 J5 J6 P8 W7) ---

_ARCHIVE = Options(method="zstd", level=5, chunk_bytes=16384, block_bytes=4096, comment="texts", digest="SHA256")


@_query("""SELECT CAST(doc_id AS VARCHAR) AS archive_id, 0 AS major, 14 AS minor, CAST(octet_length(encode(text)) AS BIGINT) AS orig_size, 'SHA256' AS digest_name, 0 AS enc_code, 0 AS "filter", 4 AS codec, 5 AS level, 5 AS match_level, 'texts' AS comment FROM documents""")
def archive_info(spark, sf):
    names = F.element_at(F.create_map(*[F.lit(x) for n, (c, _) in DIGESTS.items() for x in (c, n)]), F.col("hash_code"))
    rows = container.archives(container.packed(_files(spark, sf), _ARCHIVE))
    codec = F.col("codec").bitwiseAND(15).alias("codec")
    return rows.select("archive_id", "major", "minor", "orig_size", names.alias("digest_name"), "enc_code", "filter", codec, "level", "match_level", "comment")


@_query()
def block_index(spark, sf):
    return container.blocks(container.packed(_files(spark, sf), _ARCHIVE)).drop("error")


@_query()
def stage_percentages(spark, sf):
    return report.archive_summary(container.blocks(container.packed(_files(spark, sf), _ARCHIVE)))


@_query("SELECT CAST(doc_id AS VARCHAR) AS archive_id, CAST(0 AS BIGINT) AS damaged, CAST(0 AS BIGINT) AS misordered FROM documents")
def validate_archive(spark, sf):
    index = container.blocks(container.packed(_files(spark, sf), _ARCHIVE))
    return report.validated(index)


@_query("SELECT CAST(doc_id AS VARCHAR) AS archive_id, md5(text) AS digest, CAST(octet_length(encode(text)) AS INTEGER) AS u_len FROM documents")
def archive_roundtrip(spark, sf):
    rows = container.unpacked(container.packed(_files(spark, sf), _ARCHIVE))
    return rows.select("archive_id", F.md5("data").alias("digest"), F.octet_length("data").alias("u_len"))


def _salts(data: bytes):
    """Salts that are the same each time, for queries whose rows are compared; runs take theirs from the system."""
    import hashlib

    state = hashlib.shake_256(data)
    count = [0]

    def random(n: int) -> bytes:
        count[0] += 1
        own = state.copy()
        own.update(count[0].to_bytes(8, "little"))
        return own.digest(n)

    return random


_SEALED = Options(method="zstd", level=3, chunk_bytes=16384, block_bytes=4096, digest="SHA256", cipher="AES256", cost=6)


@_query("""SELECT CAST(doc_id AS VARCHAR) AS archive_id, md5(text) AS digest, CAST(octet_length(encode(text)) AS INTEGER) AS u_len, 2 AS enc_code, true AS size_hidden,
'the archive is encrypted' AS locked FROM documents""")
def encrypted_roundtrip(spark, sf):
    """Encrypted archives, opened with the password, and what is said without it."""
    sealed = container.packed(_files(spark, sf), _SEALED, b"a password", _salts)
    rows = container.looked_at(sealed, b"a password")
    opened = F.md5("data").alias("digest"), F.octet_length("data").alias("u_len")
    return rows.select("archive_id", *opened, "enc_code", F.col("orig_size").isNull().alias("size_hidden"), "locked")


@_query("""SELECT CAST(doc_id AS VARCHAR) AS archive_id, CASE abs(doc_id) % 3 WHEN 0 THEN 'digest' WHEN 1 THEN 'cut' ELSE 'none' END AS damage, abs(doc_id) % 3 = 2 AS ok,
CASE WHEN abs(doc_id) % 3 <> 1 THEN md5(text) END AS kept FROM documents""")
def damaged_archives(spark, sf):
    """Archives of which a third have a wrong digest and a third end early: which are told, and what is kept of them."""
    made = container.packed(_files(spark, sf), _ARCHIVE)
    turn, size = F.abs(F.col("archive_id").cast("bigint")) % 3, F.octet_length("data")
    flipped = F.unhex(F.lpad(F.hex(F.conv(F.hex(F.substring("data", size, F.lit(1))), 16, 10).cast("bigint").bitwiseXOR(255)), 2, "0"))
    front = F.substring("data", F.lit(1), size - 1)
    broken = made.select("archive_id", F.when(turn == 0, F.concat(front, flipped)).when(turn == 1, front).otherwise(F.col("data")).alias("data"))
    found = container.unpacked(broken, keep_broken=True)
    damage = F.when(turn == 0, "digest").when(turn == 1, "cut").otherwise("none")
    return found.select("archive_id", damage.alias("damage"), F.col("error").isNull().alias("ok"), F.when(turn != 1, F.md5("data")).alias("kept"))


@_query(f"""SELECT archive_id, chunk_no, eof, chunk_size, CAST(ceil(length(bin(chunk_size)) / 8.0) AS INTEGER) AS chunk_bytes FROM ({_CUT.format(size=16384)})""")
def chunk_index(spark, sf):
    """The chunks that the archives' block index tells of."""
    index = container.blocks(container.packed(_files(spark, sf), _ARCHIVE)).where("error IS NULL")
    return index.select("archive_id", "chunk_no", "eof", "chunk_size", "chunk_bytes").distinct()


@_query("SELECT lang, CAST(sum(octet_length(encode(text))) + count(*) - count(DISTINCT struct_pack(s := source, p := doc_id // 4096)) AS BIGINT) AS bytes FROM documents WHERE text IS NOT NULL GROUP BY lang")
def parse_totals(spark, sf):
    """Literal and matched bytes of ``parse_stats`` together: all bytes of the texts and of the line ends between them."""
    stats = parse_stats(spark, sf)
    return stats.select("lang", (F.col("literal_bytes") + F.col("match_bytes")).alias("bytes"))


# --- rankings (A9 W6 J7 F15 S14) ---

#: Published timings of eleven ways to pack one 1,451,397,120-byte file: name, bytes, seconds.
_METHOD_RUNS = (
    ("bzip2", 176191108, 28.257), ("gzip", 210164154, 20.007), ("lzo", 334907729, 13.781), ("standalone gzip", 323969716, 34.634), ("standalone zpaq 3", 174376833, 106.530),
    ("lzma", 145853453, 133.294), ("standalone bzip2", 264445349, 92.057), ("zpaq", 123584447, 262.230), ("standalone zpaq 4", 137916765, 300.921), ("matches only", 923624866, 13.493), ("standalone xz", 215679012, 418.508),
)
_LEVEL_RUNS = tuple((str(i + 1), *x) for i, x in enumerate(((210463000, 19.62), (192488812, 21.33), (183084179, 24.92), (178224370, 29.61), (150801305, 114.95), (149548952, 118.61), (145853453, 134.72), (145288873, 160.81), (145105437, 164.75))))


def _rank_sql(runs) -> str:
    return f"""
WITH r(name, packed_size, pack_s) AS (VALUES {", ".join(f"('{n}', CAST({b} AS BIGINT), CAST({s} AS DOUBLE))" for n, b, s in runs)}),
i AS (SELECT *, packed_size * 100.0 / max(packed_size) OVER () AS size_index, pack_s * 100.0 / max(pack_s) OVER () AS time_index FROM r)
SELECT name, packed_size, pack_s, round(size_index, 6) AS size_index, round(time_index, 6) AS time_index, round((size_index + time_index) / 2, 6) AS overall_index, CAST(rank() OVER (ORDER BY size_index + time_index) AS INTEGER) AS rank FROM i"""


def _rank(spark: SparkSession, runs) -> DataFrame:
    out = report.ranked(spark.createDataFrame(list(runs), "name string, packed_size bigint, pack_s double"))
    return out.select("name", "packed_size", "pack_s", *[F.round(c, 6).alias(c) for c in ("size_index", "time_index", "overall_index")], "rank")


@_query(_rank_sql(_METHOD_RUNS))
def rank_methods(spark, sf):
    return _rank(spark, _METHOD_RUNS)


@_query(_rank_sql(_LEVEL_RUNS))
def rank_levels(spark, sf):
    return _rank(spark, _LEVEL_RUNS)


@_query(f"""
WITH r(name, packed_size, pack_s) AS (VALUES {", ".join(f"('{n}', CAST({b} AS BIGINT), CAST({s} AS DOUBLE))" for n, b, s in _METHOD_RUNS)})
SELECT name, round(1451397120 / CAST(packed_size AS DOUBLE), 9) AS ratio, round(packed_size * 8.0 / 1451397120, 9) AS bits_per_byte, round(1451397120 / (1048576 * pack_s), 9) AS pack_mb_s, round(packed_size / (1048576 * pack_s), 9) AS unpack_mb_s FROM r
""")
def speed_table(spark, sf):
    runs = spark.createDataFrame(list(_METHOD_RUNS), "name string, packed_size bigint, pack_s double")
    runs = runs.withColumn("input_size", F.lit(1451397120)).withColumn("unpack_s", F.col("pack_s"))
    return report.speed_rows(runs).select("name", *[F.round(c, 9).alias(c) for c in ("ratio", "bits_per_byte", "pack_mb_s", "unpack_mb_s")])


# --- digests and encryption (H1-H9) ---


@_query("SELECT doc_id, md5(text) AS md5, sha256(text) AS sha256, sha1(text) AS sha1 FROM documents")
def digest_matrix(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("md5"), F.sha2("text", 256).alias("sha256"), F.sha1(F.col("text").cast("binary")).alias("sha1"))


@_query()
def digest_all(spark, sf):
    """All fourteen digests of each text."""
    return _files(spark, sf).select("archive_id", *[digests.digest(F.col("data"), n).alias(n.lower()) for n in DIGESTS])


@_query("SELECT 'all' AS archive_id, md5(string_agg(text, '' ORDER BY doc_id)) AS digest FROM documents")
def whole_digest(spark, sf):
    """One digest over all texts in order, a chunk at a time, as for one archive of many chunks."""
    docs = table(spark, sf, "documents")
    rows = docs.select(F.lit("all").alias("archive_id"), F.col("doc_id").alias("chunk_no"), F.col("text").cast("binary").alias("data"))
    return digests.digest_of_chunks(rows, "MD5")


@_query("""WITH leaf AS (SELECT CAST(doc_id AS BIGINT) AS place, md5(text) AS digest FROM documents),
a AS (SELECT place // 1024 AS place, md5(string_agg(digest, '' ORDER BY place)) AS digest FROM leaf GROUP BY place // 1024),
b AS (SELECT place // 1024 AS place, md5(string_agg(digest, '' ORDER BY place)) AS digest FROM a GROUP BY place // 1024),
c AS (SELECT place // 1024 AS place, md5(string_agg(digest, '' ORDER BY place)) AS digest FROM b GROUP BY place // 1024)
SELECT 'all' AS archive_id, md5(string_agg(digest, '' ORDER BY place)) AS digest FROM c""")
def tree_digest(spark, sf):
    """One digest over all texts by a tree, so that no task reads them all."""
    docs = table(spark, sf, "documents")
    rows = docs.select(F.lit("all").alias("archive_id"), F.col("doc_id").alias("chunk_no"), F.col("text").cast("binary").alias("data"))
    return digests.digest_tree(rows)


@_query("""SELECT doc_id, CAST(bits AS INTEGER) AS bits, CAST(octet_length(encode(text)) AS INTEGER) AS c_len, octet_length(encode(text)) >= 16 AS hidden, md5(text) AS digest
FROM documents, (VALUES (128), (256)) AS k(bits)""")
def aes_roundtrip(spark, sf):
    """Encrypt each text with a key and IV of its own and decrypt it; texts too short to steal from stay as they are."""
    docs = _docs(spark, sf).select("doc_id", F.col("text").cast("binary").alias("data"))
    parts = []
    for bits in (128, 256):
        key = F.substring(F.unhex(F.sha2(F.concat(F.lit("k"), F.col("doc_id").cast("string")), 256)), F.lit(1), F.lit(bits // 8))
        iv = F.unhex(F.md5(F.col("doc_id").cast("string").cast("binary")))
        keyed = docs.select("doc_id", "data", key.alias("key"), iv.alias("iv"), (F.octet_length("data") >= 16).alias("long"))
        c = keyed.withColumn("hidden_data", F.when(F.col("long"), crypto.encrypt(F.col("data"), F.col("key"), F.col("iv"))).otherwise(F.col("data")))
        again = F.when(F.col("long"), crypto.decrypt(F.col("hidden_data"), F.col("key"), F.col("iv"))).otherwise(F.col("hidden_data"))
        parts.append(c.select("doc_id", F.lit(bits).alias("bits"), F.octet_length("hidden_data").alias("c_len"), (F.col("hidden_data") != F.col("data")).alias("hidden"), F.md5(again).alias("digest")))
    return _union(parts)
