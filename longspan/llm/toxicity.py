"""Toxicity by maximum-scoring segments.

Fitting.  Labelled texts give, for each word and each word's prefixes, in how many lines of toxic and of other
text it stands; each distinct line counts once, so that groups of copies don't pass for evidence, nor does a word
that is repeated over and over: in fitting it counts once a line, in scoring once in ``WINDOW`` words, so that a
later passage of the same words is found as well.  The score of a
term is its log-odds under an informative Dirichlet prior (the pooled counts, scaled), less ``z`` standard
deviations.  A word with enough counts of its own uses them, any other backs off to its longest scored prefix;
everything else costs ``base``.  The expected score of a word of clean text is therefore negative.

Scoring.  A linear scan (Ruzzo and Tompa) finds all maximal-scoring segments of a text.  Under clean text a
segment of score S among n words is expected K n exp(-lambda S) times; lambda solves sum(q exp(lambda s)) = 1
and K is fitted to clean texts by the mean of the extreme-value law.  A document's evidence is the sum of
log(1 / E) over its significant segments (E below ``e_max``); a logistic curve, fitted on the labelled texts,
maps evidence to a score.

``z`` and ``e_max`` are those of ``ZS`` and ``E_MAXS`` under which each half of the labelled texts has the least
log loss by the terms of the other half; no other texts are looked at.

The labelled rows used are bounded: ``max_rows`` a class, the lowest by a hash of the id, and of these, in that order,
as many as come within ``max_chars`` characters (one at least).  The vocabulary kept is bounded by ``max_terms``.

Defined results: null and empty texts have no segment and get the score of no evidence; repeated rows are
scored alike; without labelled rows of both classes every score is the smoothed share of toxic rows, and
nearly 0 without any labels; an empty table gives an empty one; columns of the
input other than the id and the text are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import over_batches

WORDS = re.compile(r"[^\W\d_]+").findall
PREFIXES = (6, 5, 4)
ZS, E_MAXS = (1.5, 2.0, 2.5, 3.0), (0.01, 0.1, 1.0)
WINDOW = 32  # so far apart, even a word of the highest score costs more between two uses than the second gains


@dataclass
class ToxicityModel:
    words: dict[str, float] = field(default_factory=dict)
    prefixes: dict[str, float] = field(default_factory=dict)
    base: float = -0.5
    rate: float = 1.0
    log_k: float = 0.0
    e_max: float = 0.1
    bias: float = -20.0
    slope: float = 0.0

    def word_score(self, word: str) -> float:
        found = self.words.get(word)
        if found is not None:
            return found
        for n in PREFIXES:
            if len(word) >= n and (found := self.prefixes.get(word[:n])) is not None:
                return found
        return self.base


class _Scores(dict):
    """Scores by word, filled in on demand and emptied when large."""

    def __init__(self, model: ToxicityModel, limit: int = 300_000):
        super().__init__()
        self.model, self.limit = model, limit

    def __missing__(self, word: str) -> float:
        if len(self) >= self.limit:
            self.clear()
        out = self[word] = self.model.word_score(word)
        return out


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (start, end, score) of Ruzzo and Tompa, in linear time.

    Only the positive entries are visited; the sums between them come from one cumulative sum.
    """
    at = np.flatnonzero(scores > 0)
    if not len(at):
        return []
    sums = np.concatenate([[0.0], np.cumsum(scores, dtype=np.float64)])
    stack: list[tuple[float, float, int, int, int]] = []  # left sum, right sum, start, end, earlier of smaller left sum
    for i, left, right in zip(at.tolist(), sums[at].tolist(), sums[at + 1].tolist(), strict=True):
        start, end = i, i + 1
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][0] >= left:
                j = stack[j][4]
            if j < 0 or stack[j][1] >= right:
                stack.append((left, right, start, end, j))
                break
            left, start = stack[j][0], stack[j][2]
            del stack[j:]
    return [(a, b, right - left) for left, right, a, b, _ in stack]


def evidence(model: ToxicityModel, scores: np.ndarray) -> tuple[float, list[tuple[int, int, float]]]:
    """Sum of log(1 / E) over the significant segments, and those segments with their E."""
    total, found, n = 0.0, [], max(1, len(scores))
    for a, b, s in segments(scores):
        log_e = model.log_k + math.log(n) - model.rate * s
        if log_e < math.log(model.e_max):
            found.append((a, b, math.exp(max(log_e, -700.0))))
            total -= log_e
    return total, found


def _squash(x: float) -> float:
    return 1 / (1 + math.exp(-x)) if x > -700 else 0.0


def _lines(rows: list[tuple[str, int]]) -> tuple[Counter, Counter]:
    """In how many distinct lines of the toxic and of the other texts each word stands."""
    seen: set[str] = set()
    counts = (Counter(), Counter())
    for text, toxic in rows:
        for line in text.lower().split("\n"):
            if line not in seen:
                seen.add(line)
                counts[toxic].update(set(WORDS(line)))
    return counts[1], counts[0]


def _log_odds(a: Counter, b: Counter, strength: float) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Terms, their total counts, and the log-odds in ``a`` against ``b`` with their standard deviations."""
    na, nb = sum(a.values()), sum(b.values())
    terms = list(a.keys() | b.keys())
    x, y = (np.array([c[t] for t in terms], float) for c in (a, b))
    prior = strength * (x + y) + 0.05
    total = prior.sum()
    delta = np.log((x + prior) / (na + total - x - prior)) - np.log((y + prior) / (nb + total - y - prior))
    return terms, x + y, delta, np.sqrt(1 / (x + prior) + 1 / (y + prior))


def _prefixed(counts: Counter, n: int) -> Counter:
    out: Counter = Counter()
    for w, k in counts.items():
        if len(w) >= n:
            out[w[:n]] += k
    return out


class Terms:
    """The log-odds of the words and prefixes of labelled texts, from which models for any ``z`` are made."""

    def __init__(self, rows: list[tuple[str, int]], strength: float):
        a, b = _lines(rows)
        self.some = bool(a and b)
        self.words = _log_odds(a, b, strength) if self.some else None
        self.prefixes = [_log_odds(_prefixed(a, n), _prefixed(b, n), strength) for n in PREFIXES] if self.some else []

    def model(self, z: float, own: int, cap: float, base: float, max_terms: int) -> ToxicityModel:
        """The scores of words and prefixes; see the module's text."""
        model = ToxicityModel(base=base)
        if not self.some:
            return model
        clamp = lambda s: min(cap, s) if s > 0 else max(s, -2.0) + base
        for terms, _, delta, spread in self.prefixes:
            low = delta - z * spread
            model.prefixes.update({terms[i]: clamp(float(low[i])) for i in np.flatnonzero(low > 0).tolist()})
        model.prefixes = dict(sorted(model.prefixes.items(), key=lambda t: (-t[1], t[0]))[:max_terms])
        # all positive words, and those that would back off to a positive prefix though they have counts of their own
        terms, total, delta, spread = self.words
        low = delta - z * spread
        near: dict[str, float] = {}
        for i in np.flatnonzero((low > 0) | (total >= own)).tolist():
            w = terms[i]
            if low[i] > 0 or any(w[:n] in model.prefixes for n in PREFIXES if len(w) >= n):
                near[w] = clamp(float(low[i]))
        model.words = dict(sorted(near.items(), key=lambda t: (-abs(t[1]), t[0]))[:max_terms])
        return model


def word_scores(get, text: str, base: float) -> np.ndarray:
    """Scores of a text's words in order; a positive word costs ``base`` within ``WINDOW`` words of a use that counted."""
    words = WORDS(text.lower())
    scores = np.fromiter(map(get, words), float, len(words))
    counted: dict[str, int] = {}
    for i in np.flatnonzero(scores > 0).tolist():
        if i - counted.get(words[i], -WINDOW) < WINDOW:
            scores[i] = base
        else:
            counted[words[i]] = i
    return scores


def _scored(model: ToxicityModel, texts: list[str]) -> list[np.ndarray]:
    get = _Scores(model).__getitem__
    return [word_scores(get, x, model.base) for x in texts]


def calibrate(model: ToxicityModel, scored: list[np.ndarray], labels: np.ndarray, e_maxs: tuple[float, ...] = E_MAXS) -> float:
    """Set the extreme-value law from clean texts, ``e_max`` and the logistic curve from all; returns the log loss a text."""
    clean = [v for v, y in zip(scored, labels, strict=True) if not y and len(v)]
    s, k = np.unique(np.concatenate([*clean, [model.base, 1.0]]), return_counts=True)
    q = k / k.sum()
    low, high = 1e-3, 5.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if q @ np.exp(mid * s) < 1 else (low, mid)
    model.rate = low
    found = [(max(1, len(v)), np.array([t for _, _, t in segments(v)])) for v in scored]
    tops = [model.rate * float(t.max(initial=0.0)) - math.log(n) for (n, t), y, v in zip(found, labels, scored, strict=True) if not y and len(v)]
    model.log_k = float(np.mean(tops)) - 0.5772156649 if tops else 0.0
    y, best = labels.astype(float), math.inf
    for e_max in e_maxs:
        log_e = [model.log_k + math.log(n) - model.rate * t for n, t in found]
        x = np.log1p([-float(e[e < math.log(e_max)].sum()) if len(e) else 0.0 for e in log_e])
        theta = _logistic(x, y)
        p = 1 / (1 + np.exp(-np.clip(theta[0] + max(0.0, theta[1]) * x, -30, 30)))
        loss = float(-np.mean(np.where(y > 0, np.log(p), np.log1p(-p))))
        if loss < best:
            best, model.e_max, model.bias, model.slope = loss, e_max, float(theta[0]), max(0.0, float(theta[1]))
    return best


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Bias and slope by Newton's method with a small ridge."""
    design = np.stack([np.ones_like(x), x], 1)
    theta, ridge = np.zeros(2), np.array([1e-3, 1e-2])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ theta, -30, 30)))
        grad = design.T @ (p - y) + ridge * theta
        hess = (design * (p * (1 - p))[:, None]).T @ design + np.diag(ridge)
        step = np.clip(np.linalg.solve(hess, grad), -5, 5)
        theta -= step
        if np.abs(step).max() < 1e-8:
            break
    return theta


def fit(
    rows: list[tuple[str, int]],
    strength: float = 0.03,
    zs: tuple[float, ...] = ZS,
    own: int = 10,
    cap: float = 6.0,
    base: float = -0.5,
    max_terms: int = 100_000,
) -> ToxicityModel:
    """Fit on (text, label) rows.  ``z``, ``e_max`` and the calibration come from scores of each half under the terms of the other half."""
    rows = sorted((x, y) for x, y in rows if x)
    options = (own, cap, base, max_terms)
    n_toxic = sum(y for _, y in rows)
    whole = Terms(rows, strength)
    halves = [[r for r in rows if zlib.crc32(r[0].encode("utf-8", "replace")) & 1 == h] for h in (0, 1)]
    labels = np.array([y for half in halves for _, y in half])
    terms = [Terms(half, strength) for half in halves]
    best, chosen = math.inf, None
    for z in zs:
        model = whole.model(z, *options)
        if not model.words:
            continue
        scored = [v for mine, other in ((0, 1), (1, 0)) for v in _scored(terms[other].model(z, *options), [x for x, _ in halves[mine]])]
        loss = calibrate(model, scored, labels)
        if loss < best:
            best, chosen = loss, model
    if chosen is None:
        p = (n_toxic + 0.5) / (len(rows) + 1)
        chosen = ToxicityModel(base=base, bias=math.log(p / (1 - p)) if rows else -20.0)
    return chosen


def labelled_sample(docs: DataFrame, labels: DataFrame, max_rows: int = 6_000, max_chars: int = 40_000_000) -> list[tuple[str, int]]:
    """At most ``max_rows`` labelled rows of each class, the lowest by a hash of the id, within ``max_chars``; ``docs`` is already the training fold.

    The ids are chosen from the labels alone and are at most ``2 * max_rows``, so they are broadcast and no
    text is shuffled but those chosen.
    """
    marks = labels.selectExpr("CAST(doc_id AS bigint) doc_id", "CAST(toxic AS int) toxic").where("doc_id IS NOT NULL AND toxic IN (0, 1)")
    marks = marks.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    lot = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003))
    chosen = [marks.where(F.col("toxic") == t).withColumn("lot", lot).orderBy("lot", "doc_id").limit(max_rows) for t in (0, 1)]
    rows = docs.selectExpr("CAST(doc_id AS bigint) doc_id", "text").where("text IS NOT NULL")
    out = []
    for t, ids in enumerate(chosen):
        part = rows.join(F.broadcast(ids.select("doc_id", "lot")), "doc_id").orderBy("lot", "doc_id", "text").limit(max_rows)
        left = max_chars
        for r in part.select("text").toLocalIterator():
            left -= len(r["text"])
            if left < 0 and left + len(r["text"]) < max_chars:
                break
            out.append((r["text"], t))
    return out


SCHEMA = "doc_id bigint, score double, evidence double, passages array<struct<start:int,end:int,e_value:double>>"


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """Score whole texts; ``passages`` are word ranges of significant segments."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = shared.value
        get = _Scores(m).__getitem__
        passage = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("e_value", pa.float64())]))

        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            scores, sums, found = [], [], []
            for text in batch.column(1).to_pylist():
                total, parts = evidence(m, word_scores(get, text or "", m.base))
                scores.append(_squash(m.bias + m.slope * math.log1p(total)))
                sums.append(total)
                found.append([{"start": a, "end": b, "e_value": e} for a, b, e in parts])
            return pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores, pa.float64()), pa.array(sums, pa.float64()), pa.array(found, passage)],
                ["doc_id", "score", "evidence", "passages"],
            )

        return f

    return over_batches(docs.selectExpr("CAST(doc_id AS bigint) doc_id", "text"), make, SCHEMA)
