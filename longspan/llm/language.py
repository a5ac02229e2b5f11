"""Language identification by known words first, then by shorter and shorter character n-grams.

A known word scores its smoothed log frequency in each language.  An unseen word is marked at both ends and
cut into n-grams; the longest length of which any n-gram is known gives its score, the mean over those known.
A text's log-likelihood is the sum over its words; it is tempered to the weight of ``tempered`` words at most
before it becomes a probability, so that long texts don't all end at 1.

Fitting uses at most ``max_rows`` texts a language (the lowest by a hash of id and text), of these as many as come within
``max_chars`` characters (one at least), each distinct line once.  Tables are bounded by ``max_words`` and ``max_grams``.

Defined results: a null text, an empty text and one without a letter give ``und`` with score 0; so does every
text when no language was learned; repeated rows are scored alike; ties go to the language first in order; an
empty table gives an empty one; further columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import over_batches

WORDS = re.compile(r"[^\W\d_]+").findall
ORDERS = (5, 4, 3, 2, 1)


@dataclass
class LanguageModel:
    langs: list[str] = field(default_factory=list)
    words: dict[str, int] = field(default_factory=dict)
    grams: list[dict[str, int]] = field(default_factory=list)  # by ORDERS
    word_rows: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.float32))
    gram_rows: list[np.ndarray] = field(default_factory=list)

    def row(self, word: str) -> np.ndarray:
        """Log frequencies of a word by language, backing off for unseen ones."""
        i = self.words.get(word)
        if i is not None:
            return self.word_rows[i]
        marked = f"^{word}$"
        for n, table, rows in zip(ORDERS, self.grams, self.gram_rows, strict=True):
            known = [k for j in range(len(marked) - n + 1) if (k := table.get(marked[j : j + n])) is not None]
            if known:
                return rows[known].mean(0)
        return np.zeros(len(self.langs), np.float32)


def _table(counts: list[Counter], limit: int) -> tuple[dict[str, int], np.ndarray]:
    total: Counter = Counter()
    for c in counts:
        total.update(c)
    terms = [t for t, _ in sorted(total.items(), key=lambda x: (-x[1], x[0]))[:limit]]
    x = np.array([[c[t] for c in counts] for t in terms], float).reshape(len(terms), len(counts))
    size = np.array([sum(c.values()) for c in counts], float)
    rows = np.log((x + 0.1) / (size + 0.1 * (len(total) + 1)))
    return {t: i for i, t in enumerate(terms)}, rows.astype(np.float32)


def fit(rows: list[tuple[str, str]], max_words: int = 200_000, max_grams: int = 50_000) -> LanguageModel:
    """Fit on (text, language) rows."""
    langs = sorted({y for x, y in rows if x})
    words = [Counter() for _ in langs]
    seen: set[tuple[str, str]] = set()
    at = {y: i for i, y in enumerate(langs)}
    for text, lang in rows:
        for line in (text or "").lower().split("\n"):
            if (lang, line) not in seen:
                seen.add((lang, line))
                words[at[lang]].update(WORDS(line)) if lang in at else None
    model = LanguageModel(langs)
    model.words, model.word_rows = _table(words, max_words)
    for n in ORDERS:
        grams = [Counter() for _ in langs]
        for c, g in zip(words, grams, strict=True):
            for w, k in c.items():
                marked = f"^{w}$"
                for j in range(len(marked) - n + 1):
                    g[marked[j : j + n]] += k
        table, scores = _table(grams, max_grams)
        model.grams.append(table)
        model.gram_rows.append(scores)
    return model


def training_sample(docs: DataFrame, max_rows: int = 1_500, max_langs: int = 1_000, max_chars: int = 20_000_000) -> list[tuple[str, str]]:
    """At most ``max_rows`` (text, lang) rows of each of the ``max_langs`` most frequent languages.

    They are the lowest by a hash of id and text, so that rows of one id don't stand or fall together, and those of a language
    that go beyond ``max_chars`` are left out, in that order.  The languages' sizes give the driver a threshold of that hash for
    each, so that only some more rows than needed are moved.
    """
    known = docs.selectExpr("CAST(doc_id AS bigint) doc_id", "text", "lang").where("lang IS NOT NULL AND text IS NOT NULL")
    sizes = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_langs).collect()
    if not sizes:
        return []
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], min(1.0, 1.5 * max_rows / r["count"] + 0.001))])
    lot = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_003)) / F.lit(1_000_003.0)
    drawn = known.withColumn("lot", lot).where(F.col("lot") <= share[F.col("lang")])
    order = Window.partitionBy("lang").orderBy("lot", "doc_id", "text")
    kept = drawn.withColumn("place", F.row_number().over(order)).where(F.col("place") <= max_rows)
    out: list[tuple[str, str]] = []
    used: Counter = Counter()
    for r in kept.orderBy("lang", "place").select("text", "lang").toLocalIterator():
        if not used[r["lang"]] or used[r["lang"]] + len(r["text"]) <= max_chars:
            out.append((r["text"], r["lang"]))
            used[r["lang"]] += max(1, len(r["text"]))
    return out


class _Rows(dict):
    """Word -> row of a matrix that fills on demand; starts anew when full."""

    def __init__(self, model: LanguageModel, limit: int = 150_000):
        super().__init__()
        self.model, self.limit = model, limit
        self.matrix = np.zeros((limit, len(model.langs)), np.float32)

    def __missing__(self, word: str) -> int:
        i = len(self)
        if i >= self.limit:
            raise OverflowError
        self.matrix[i] = self.model.row(word)
        self[word] = i
        return i

    def total(self, words: list[str]) -> np.ndarray:
        try:
            at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        except OverflowError:
            self.clear()
            if len(set(words)) > self.limit:
                return sum((self.total(words[i : i + self.limit]) for i in range(0, len(words), self.limit)), np.zeros(self.matrix.shape[1]))
            at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        return self.matrix[at].sum(0, dtype=np.float64)


def predict_text(rows: _Rows, text: str | None, tempered: int = 20) -> tuple[str, float]:
    words = WORDS((text or "").lower())
    if not rows.model.langs or not any(c.isalpha() for w in words for c in w):
        return "und", 0.0
    total = rows.total(words) * (tempered / (tempered + len(words)))
    odds = np.exp(total - total.max())
    best = int(odds.argmax())
    return rows.model.langs[best], float(odds[best] / odds.sum())


def annotate(docs: DataFrame, model: LanguageModel, lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """All columns of ``docs`` but any of these two names, then the predicted language and its score."""
    docs = docs.drop(lang, score)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = StructType([*docs.schema.fields, StructField(lang, StringType()), StructField(score, DoubleType())])
    place, names = docs.columns.index("text"), schema.names

    def make():
        rows = _Rows(shared.value)

        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [predict_text(rows, x) for x in batch.column(place).to_pylist()]
            more = [pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())]
            return pa.RecordBatch.from_arrays([*batch.columns, *more], names)

        return f

    return over_batches(docs, make, schema)


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``doc_id, lang_pred, score`` of every row."""
    return annotate(docs.selectExpr("CAST(doc_id AS bigint) doc_id", "text"), model).drop("text")


def keep_known(docs: DataFrame, model: LanguageModel, least: float = 0.5) -> DataFrame:
    """The rows whose language is recognised with ``least`` confidence; a missing ``lang`` is filled in."""
    found = annotate(docs, model, "_found_lang", "_found_score").where((F.col("_found_lang") != "und") & (F.col("_found_score") >= least))
    return found.withColumn("lang", F.coalesce("lang", "_found_lang")).select(*docs.columns)
