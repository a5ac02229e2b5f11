"""Benchmark decontamination by the q-gram lemma over overlapping diagonal bands.

Items and texts are lower-cased and their white space made single blanks.  An occurrence of an item of m
characters with at most k edits keeps m - q + 1 - k q of the item's q-grams, all on diagonals (text place less
item place) that span at most k.  Each hit is counted in the two bands of width 2 (k + 1), one stride of k + 1
apart, that hold its diagonal, so k + 1 neighbouring diagonals always lie in one band whole.  Bands that reach
the bound are widened by k on both sides, joined where they overlap, and verified by an alignment of the whole
item that fills those diagonals only: O(m k) for a band.

Texts that repeat a few q-grams over and over have too many hits to list (``LIMIT``).  There each q-gram's text
places are first put into cells of one stride, and each of the item's q-grams marks whole cells: counts can only
come out higher, so nothing is lost, and the work is that of m passes over the text's cells.

``edits`` gives the budget: k = floor(edits * m), lowered for short items to the largest k whose bound is at
least 1; an item shorter than q is looked for as it is.  Items are taken in blocks of at most ``block_chars``
characters, so what is sent to the tasks is bounded (an index of 16 bytes a character); every block meets all texts.

Defined results: null or empty texts and items match nothing; repeated rows are reported each, with their id;
empty tables give an empty result; other columns of either table are ignored; of an item's regions in a text
the one with the fewest edits is given, the leftmost of these.  ``shared`` is how many of the item's q-grams the
region holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import over_batches, slices

Q, EDITS, BLOCK_CHARS = 8, 0.1, 5_000_000
LIMIT = 2_000_000  # hits listed at once
SLICE_CHARS = 500_000  # of texts searched at once (about 80 bytes a character)
SPAN = 65_536  # diagonals aligned at once
BITS = 23
SCHEMA = "doc_id bigint, item_id bigint, start bigint, length bigint, n_edits int, shared int"


def canonical(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def budget(m: int, q: int, edits: float) -> int:
    """Edits allowed in an item of ``m`` >= q characters."""
    return min(int(edits * m), (m - q) // q)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _hashes(codes: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of each q-gram, put together from hashes of powers of two."""
    odd = np.uint64(0x9E3779B97F4A7C15)
    part = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    out, covered, size, at = None, 0, 1, q
    with np.errstate(over="ignore"):
        while at:
            if at & 1:
                n = len(codes) - covered - size + 1
                if n <= 0:
                    return np.zeros(0, np.uint64)
                out = part[:n] if out is None else out[:n] * odd + part[covered : covered + n]
                covered += size
            at >>= 1
            if at:
                if len(part) <= size:
                    return np.zeros(0, np.uint64)
                part = (part[:-size] ^ (part[:-size] >> np.uint64(29))) * odd + part[size:]
                size *= 2
        out = (out ^ (out >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return out


class ItemIndex:
    """The q-grams of a block of items, sorted by hash, behind a bitmap of hash prefixes."""

    def __init__(self, items: list[tuple[int, str]], q: int = Q, edits: float = EDITS):
        self.q = q
        texts = [(i, canonical(x)) for i, x in items]
        self.short = [(i, x) for i, x in texts if 0 < len(x) < q]
        self.items = [(i, x, _codes(x)) for i, x in texts if len(x) >= q]
        self.k = np.array([budget(len(x), q, edits) for _, x, _ in self.items], np.int64)
        self.m = np.array([len(x) for _, x, _ in self.items], np.int64)
        self.need = self.m - q + 1 - self.k * q
        grams = [_hashes(c, q) for _, _, c in self.items]
        empty = np.zeros(0, np.int64)
        hashes = np.concatenate([np.zeros(0, np.uint64), *grams])
        order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[order]
        self.item = np.concatenate([empty, *(np.full(len(g), j) for j, g in enumerate(grams))])[order].astype(np.int32)
        self.place = np.concatenate([empty, *(np.arange(len(g)) for g in grams)])[order].astype(np.int32)
        self.bitmap = np.zeros(1 << BITS, bool)
        self.bitmap[self.hashes >> np.uint64(64 - BITS)] = True

    def ranges(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text place, first row of the index, number of rows) of every q-gram in common."""
        at = np.flatnonzero(self.bitmap[hashes >> np.uint64(64 - BITS)])
        found = hashes[at]
        low = np.searchsorted(self.hashes, found, "left")
        n = np.searchsorted(self.hashes, found, "right") - low
        keep = n > 0
        return at[keep], low[keep], n[keep]


def align(item: np.ndarray, codes: np.ndarray, begin: np.ndarray, end: np.ndarray, low: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(edits, start, end) of the best occurrence of all of ``item`` on the diagonals ``low`` .. ``low`` + ``width`` of each text.

    ``codes[begin:end]`` is a text; all are aligned at once.  A cell is an item row and a diagonal, and holds edits in
    the high bits, and in the low ones the start, latest first.  A skipped item character comes from the next diagonal,
    a further text character from the one before, by a running minimum.  The fewest edits win, then the leftmost end,
    then the latest start; starts are relative to the text.
    """
    one, big = np.int64(1) << 36, np.int64(1) << 61
    drift = np.arange(width) * one  # left out of the cells, so that a further text character costs nothing there
    place = low[:, None] + np.arange(width)
    size = (end - begin)[:, None]
    cost = np.where((place >= 0) & (place <= size), one - 1 - place, big) - drift
    at = low[:, None] + np.arange(width + len(item))
    codes = codes if len(codes) else np.zeros(1, np.uint32)
    # beyond a text's ends nothing is equal: there a character used up costs as much as one skipped, whose end is further left
    text = np.where((at >= 0) & (at < size), codes[np.clip(begin[:, None] + at, 0, len(codes) - 1)], np.uint32(0xFFFFFFFF))
    skipped = np.empty_like(cost[:, 1:])
    for i, c in enumerate(item):
        np.add(cost[:, 1:], 2 * one, out=skipped)
        cost += (text[:, i : i + width] != c) * one
        np.minimum(cost[:, :-1], skipped, out=cost[:, :-1])
        np.minimum.accumulate(cost, axis=1, out=cost)
    cost += drift
    place += len(item)
    edits = np.where((place >= 0) & (place <= size), cost >> 36, big)
    best = edits.argmin(axis=1)
    row = np.arange(len(cost))
    start = one - 1 - (cost[row, best] & (one - 1))
    return edits[row, best], start, place[row, best]


def candidates(index: ItemIndex, at: np.ndarray, low: np.ndarray, n: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, item, band) of every band that reaches its bound, given the hits in joined texts.

    Bands are first counted in hashed buckets, which can only count too many, then exactly, each of an item's
    q-grams once however often the text repeats it.
    """
    rows = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    places = np.repeat(at, n)
    item, own = index.item[rows].astype(np.int64), index.place[rows].astype(np.int64)
    doc = np.searchsorted(starts, places, "right") - 1
    stride = index.k[item] + 1
    band = (places - starts[doc] - own) // stride + (index.m[item] // stride + 2)  # positive
    doc, item = np.concatenate([doc, doc]), np.concatenate([item, item])
    band = np.concatenate([band, band - 1])
    need = index.need[item]
    mixed = ((doc * len(index.items) + item).astype(np.uint64) << np.uint64(30)) + band.astype(np.uint64)
    with np.errstate(over="ignore"):
        bucket = ((mixed * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)
    keep = np.bincount(bucket, minlength=1 << 20)[bucket] >= need
    place = np.concatenate([own, own])[keep]
    pair, of = np.unique((doc * len(index.items) + item)[keep], return_inverse=True)
    wide, long = int(band.max(initial=0)) + 1, int(place.max(initial=0)) + 1
    found, of = np.unique(of * wide + band[keep], return_inverse=True)
    counts = np.bincount(np.unique(of * long + place) // long, minlength=len(found))
    pair, band = pair[found // wide], found % wide
    doc, item = pair // len(index.items) if len(pair) else pair, pair % max(1, len(index.items))
    good = counts >= index.need[item]
    return doc[good], item[good], (band - (index.m[item] // (index.k[item] + 1) + 2))[good]


def cell_candidates(index: ItemIndex, hashes: np.ndarray, at: np.ndarray, low: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(item, band) of a text of very many hits: all bands that ``candidates`` would give, maybe more."""
    order = np.argsort(hashes[at], kind="stable")
    text, value = at[order], hashes[at][order]
    head = np.flatnonzero(np.diff(value, prepend=~value[:1]) != 0) if len(value) else np.zeros(0, np.int64)
    tail = np.append(head[1:], len(value))
    rows_low, rows_n = low[order][head], n[order][head]
    rows = np.repeat(rows_low, rows_n) + np.arange(rows_n.sum()) - np.repeat(np.cumsum(rows_n) - rows_n, rows_n)
    gram = np.repeat(np.arange(len(head)), rows_n)
    by_item = np.argsort(index.item[rows], kind="stable")
    rows, gram = rows[by_item], gram[by_item]
    item = index.item[rows]
    edges = np.flatnonzero(np.diff(item, prepend=-1, append=-1))
    items, bands = [], []
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        j = int(item[a])
        if b - a < index.need[j]:
            continue
        stride, m = int(index.k[j]) + 1, int(index.m[j])
        shift = m // stride + 4  # makes all bands positive
        counts = np.zeros(len(hashes) // stride + shift + 6, np.int32)
        marks: dict[int, np.ndarray] = {}
        for g, p in zip(gram[a:b].tolist(), index.place[rows[a:b]].tolist(), strict=True):
            if g not in marks:
                cells = text[head[g] : tail[g]] // stride
                cells = cells[np.diff(cells, prepend=-1) > 0]  # ascending
                # the diagonals of a cell lie in two cells at most, these in three bands
                marks[g] = np.unique(np.concatenate([cells - 1, cells, cells + 1]) if stride > 1 else np.concatenate([cells - 1, cells]))
            counts[marks[g] + (shift + (-p) // stride)] += 1
        good = np.flatnonzero(counts >= index.need[j])
        items.append(np.full(len(good), j))
        bands.append(good - shift)
    empty = np.zeros(0, np.int64)
    return np.concatenate([empty, *items]), np.concatenate([empty, *bands])


def spans(k: int, bands: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of diagonals (first, how many) that the bands need, joined where they overlap; wide ones cut again, with overlap."""
    low, high = bands * (k + 1) - k, (bands + 2) * (k + 1) + k
    cut = np.flatnonzero(low[1:] > high[:-1]) + 1
    out = []
    for a, b in zip(low[np.append(0, cut)].tolist(), high[np.append(cut - 1, len(bands) - 1)].tolist(), strict=True):
        for x in range(a, b, SPAN):  # a path that starts inside stays within k
            out.append((max(a, x - k), min(b, x + SPAN + k) - max(a, x - k)))
    return out


def verified(index: ItemIndex, clean: list[str], codes: np.ndarray, starts: np.ndarray, doc: np.ndarray, item: np.ndarray, band: np.ndarray) -> Iterator[tuple]:
    """(text, item id, start, length, edits, shared q-grams) of each item that occurs in one of its bands of a text."""
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    todo: dict[tuple[int, int], list[tuple[int, int]]] = {}  # by item and width: text, first diagonal
    order = np.lexsort((band, item, doc))
    doc, item, band = doc[order], item[order], band[order]
    edges = np.flatnonzero((np.diff(doc, prepend=-1, append=-1) != 0) | (np.diff(item, prepend=-1, append=-1) != 0)) if len(doc) else [0]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        i, j = int(doc[a]), int(item[a])
        at = clean[i].find(index.items[j][1])
        if at >= 0:
            best[i, j] = (0, at, at + int(index.m[j]))
        elif index.k[j]:
            for low, width in spans(int(index.k[j]), band[a:b]):
                todo.setdefault((j, width), []).append((i, low))
    for (j, width), where in todo.items():
        k, most = int(index.k[j]), max(1, SPAN // width)
        for at in range(0, len(where), most):
            texts, low = (np.array(x) for x in zip(*where[at : at + most], strict=True))
            found = align(index.items[j][2], codes, starts[texts], starts[texts] + np.array([len(clean[i]) for i in texts]), low, width)
            for i, n_edits, start, end in zip(texts.tolist(), *(x.tolist() for x in found), strict=True):
                if n_edits <= k and ((i, j) not in best or (n_edits, start) < best[i, j][:2]):
                    best[i, j] = (n_edits, start, end)
    for (i, j), (n_edits, start, end) in sorted(best.items()):
        own = codes[starts[i] + start : starts[i] + end]
        shared = int(np.isin(_hashes(index.items[j][2], index.q), _hashes(own, index.q)).sum())
        yield i, index.items[j][0], start, end - start, n_edits, shared


def _search(index: ItemIndex, clean: list[str], first: int) -> Iterator[tuple]:
    codes = _codes("\0".join(clean))
    starts = np.cumsum([0, *(len(x) + 1 for x in clean)])
    hashes = _hashes(codes, index.q)
    at, low, n = index.ranges(hashes)
    if n.sum() <= LIMIT:
        found = candidates(index, at, low, n, starts)
    elif len(clean) > 1:
        half = len(clean) // 2
        yield from _search(index, clean[:half], first)
        yield from _search(index, clean[half:], first + half)
        return
    else:
        item, band = cell_candidates(index, hashes, at, low, n)
        found = np.zeros(len(item), np.int64), item, band
    yield from ((first + i, *m) for i, *m in verified(index, clean, codes, starts, *found))


def search(index: ItemIndex, texts: list[str | None]) -> Iterator[tuple]:
    """(place in ``texts``, item id, start, length, edits, shared q-grams)."""
    for a, b in slices(texts, 4000, SLICE_CHARS):
        clean = [canonical(x) for x in texts[a:b]]
        for ident, x in index.short:
            yield from ((a + i, ident, at, len(x), 0, 0) for i, t in enumerate(clean) if (at := t.find(x)) >= 0)
        yield from _search(index, clean, a)


def _blocks(items: DataFrame, limit: int) -> Iterator[list[tuple[int, str]]]:
    block, size = [], 0
    for r in items.selectExpr("CAST(item_id AS bigint) item_id", "text").where("text IS NOT NULL").toLocalIterator():
        block.append((r["item_id"], r["text"]))
        size += len(r["text"])
        if size > limit:
            yield block
            block, size = [], 0
    if block:
        yield block


def find_items(
    docs: DataFrame, items: DataFrame, q: int = Q, edits: float = EDITS, block_chars: int = BLOCK_CHARS
) -> DataFrame:
    """One row per text and item that occurs in it: where, how long, with how many edits."""
    spark = docs.sparkSession
    out = spark.createDataFrame([], SCHEMA)
    texts = docs.selectExpr("CAST(doc_id AS bigint) doc_id", "text")
    for block in _blocks(items, block_chars):
        shared = spark.sparkContext.broadcast(block)

        def make(shared=shared):
            index = ItemIndex(shared.value, q, edits)

            def f(batch: pa.RecordBatch) -> pa.RecordBatch:
                ids = batch.column(0).to_pylist()
                rows = [(ids[m[0]], *m[1:]) for m in search(index, batch.column(1).to_pylist())]
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
                names = [x.split()[0] for x in SCHEMA.split(", ")]
                return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

            return f

        out = out.unionAll(over_batches(texts, make, SCHEMA))
    return out
