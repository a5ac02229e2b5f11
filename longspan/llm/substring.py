"""Removal of repeated passages: every window of ``window`` words whose word sequence starts earlier elsewhere.

Texts are sharded by content.  The least hash among a window's m-word grams (leftmost on ties) is its anchor;
equal windows have equal anchors, so all copies of a passage meet in one shard however texts are spread.
Neighbouring windows with one anchor form a stretch of at most 2 * window - m words.

 P1  each group of texts sends its distinct anchors; the anchors found twice come back;
 P2  each group sends the distinct stretches that hold such an anchor, as a hash with the place of the first;
     for each stretch the group that holds the earliest one hears so;
 P3  that group sends the words of its stretch to the anchor's shard; all other copies are repeats as they are;
 P4  each shard indexes its stretches (FM-index), streams them through it for the matching statistics, and
     answers which windows of a stretch have an earlier copy in another stretch;
 P5  each group removes what is covered and digests the rest.

A group sends a hot passage once however often it has it, so a shard hears of a passage from each group once at
most.  An anchor that heads more than ``hot`` stretches is not indexed: its windows go one by one, each to the
shard of its own words, where equality alone tells the earliest; so no shard grows with such an anchor.  Groups
hold about ``group_bytes`` of text.  All passes read one shuffle of the texts by group.

Earlier means a smaller id, or a smaller start in the same document; a null id comes last.  Rows of one id
count as one document, so equal starts in them are not earlier than each other.  Defined results: null and
empty texts have no words; texts shorter than the window keep all words; an empty table gives an empty one;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, tidy
from .fmindex import FMIndex
from .wordhash import _INVERSE, _MULTIPLIER, encode, mix, word_hashes

WINDOW, GRAM, GROUP_BYTES, INDEX_WORDS, HOT = 20, 4, 8_000_000, 1_000_000, 50_000
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_LAST = (1 << 63) - 1
_SINGLE = 1 << 20


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the leftmost least value among ``width`` from each place on."""
    best, reach = np.arange(len(values)), 1
    while reach < width:
        step = min(reach, width - reach)
        if len(best) <= step:
            return best[:0]
        a, b = best[:-step], best[step:]
        best = np.where(values[a] <= values[b], a, b)
        reach += step
    return best


class Stretches:
    """Word hashes of a group's texts and its stretches: windows [first, last] of one anchor."""

    def __init__(self, table: pa.Table, window: int, gram: int):
        ids, texts = table.column("doc_id").to_pylist(), table.column("text").to_pylist()
        order = sorted(range(len(ids)), key=lambda i: (_LAST if ids[i] is None else ids[i], texts[i] or "", texts[i] is None))
        self.ids = [ids[i] for i in order]
        self.raw = [encode(texts[i]) for i in order]
        self.window = window
        hashes, bounds, base = [], [np.zeros(1, np.int64)], 0
        for a, b in slices(self.raw, 100_000, 4_000_000):
            h, cut = word_hashes(self.raw[a:b])
            hashes.append(h)
            bounds.append(cut[1:] + base)
            base += len(h)
        self.words = np.concatenate([np.zeros(0, np.uint64), *hashes])
        self.bounds = np.concatenate(bounds)
        sizes = np.diff(self.bounds)
        n = len(self.words)
        row = np.repeat(np.arange(len(order)), sizes)
        self.key = np.array([_LAST if i is None else i for i in self.ids], np.int64)
        with np.errstate(over="ignore"):
            grams = self.words[: max(0, n - gram + 1)].copy()
            for i in range(1, gram):
                grams = mix(grams * _GOLD + self.words[i : i + len(grams)])
        anchor = _least(grams, window - gram + 1)
        inside = row[: len(anchor)] == row[window - 1 : window - 1 + len(anchor)]
        at = np.flatnonzero(inside)
        anchor = anchor[at]
        new = np.ones(len(at), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)
        head = np.flatnonzero(new)
        self.begin = at[head]
        self.end = at[np.append(head[1:], len(at)).astype(np.int64) - 1] + window if len(at) else self.begin
        self.anchor = grams[anchor[head]].view(np.int64)
        self.row = row[self.begin]
        self.doc = self.key[self.row]
        self.start = self.begin - self.bounds[self.row]

    def windows(self, stretches: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(where each window of these stretches begins, its stretch)."""
        n = self.end[stretches] - self.begin[stretches] - self.window + 1
        owner = np.repeat(stretches, n)
        return self.begin[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n), owner

    def hashed(self, begin: np.ndarray, end: np.ndarray, salt: int = 0) -> np.ndarray:
        """A hash of the words of each range; windows sent one by one are salted, to be told from short stretches."""
        with np.errstate(over="ignore"):
            n = len(self.words)
            power = np.full(n + 1, _MULTIPLIER, np.uint64)
            back = np.full(n + 1, _INVERSE, np.uint64)
            power[0] = back[0] = 1
            power, back = np.multiply.accumulate(power), np.multiply.accumulate(back)
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.words * power[:n], dtype=np.uint64)])
            out = (sums[end] - sums[begin]) * back[begin]
            return mix(out + (end - begin + salt).astype(np.uint64) * _GOLD).view(np.int64)


def _blob(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x, np.int64).tobytes()


def _joined(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(x for x in column.to_pylist() if x), np.int64)


def _firsts(key: np.ndarray, doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """For each distinct key the entry of the least (doc, start)."""
    order = np.lexsort((start, doc, key))
    return order[np.diff(key[order], prepend=key[order[:1]] ^ 1 if len(order) else None) != 0] if len(order) else order


ANSWER = "grp int, yes binary, no binary"


def _answers(grp: np.ndarray, value: np.ndarray, yes: np.ndarray) -> pa.RecordBatch:
    order = np.argsort(grp, kind="stable")
    grp, value, yes = grp[order], value[order], yes[order]
    edges = np.flatnonzero(np.diff(grp, prepend=-1, append=-1)) if len(grp) else np.zeros(1, np.int64)
    parts = list(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))
    return pa.RecordBatch.from_arrays(
        [
            pa.array([int(grp[a]) for a, _ in parts], pa.int32()),
            pa.array([_blob(value[a:b][yes[a:b]]) for a, b in parts], pa.binary()),
            pa.array([_blob(value[a:b][~yes[a:b]]) for a, b in parts], pa.binary()),
        ],
        ["grp", "yes", "no"],
    )


def _columns(batches: Iterator[pa.RecordBatch]) -> list[np.ndarray] | None:
    held = [[c.to_numpy(zero_copy_only=False) for c in b.columns] for b in batches if b.num_rows]
    return [np.concatenate(x) for x in zip(*held, strict=True)] if held else None


def _twice(hot: int):
    """A function of a shard's anchors (anchor, grp, n): those found twice go back to their groups, as yes; those
    of more than ``hot`` stretches as no."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cols = _columns(batches)
        if cols:
            anchor, grp, n = cols
            _, inverse = np.unique(anchor, return_inverse=True)
            total = np.bincount(inverse, n)[inverse]
            keep = total > 1
            yield _answers(grp[keep], anchor[keep], total[keep] <= hot)

    return run


def _earliest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contents of a shard (content, grp, doc, start): the group of the least place hears yes, the others no."""
    cols = _columns(batches)
    if cols:
        content, grp, doc, start = cols
        first = np.zeros(len(content), bool)
        first[_firsts(content, doc, start)] = True
        yield _answers(grp, content, first)


WORDS = "anchor bigint, grp int, row int, doc bigint, start int, words binary"
COVER = "grp int, row int, begin int, end int"


def _cover(grp, row, begin, end) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int32()) for x in (grp, row, begin, end)], ["grp", "row", "begin", "end"])


def _index_shard(window: int, index_words: int):
    """A function over a shard's stretches, sorted by anchor: indexes whole anchors, some at a time."""

    def repeats(unit: list[tuple]) -> pa.RecordBatch | None:
        _, grp, row, doc, start, words = (np.array(x) if i < 5 else x for i, x in enumerate(zip(*unit, strict=True)))
        sizes = np.array([len(x) // 8 for x in words])
        flat = np.frombuffer(b"".join(words), np.uint64)
        _, ids = np.unique(flat, return_inverse=True)
        end = np.cumsum(sizes + 1) - 1
        begin = end - sizes
        text = np.zeros(len(flat) + len(sizes), np.int64)
        inside = np.ones(len(text), bool)
        inside[end] = False
        text[inside] = ids + 1
        # the places in order of (doc, start), so that a block's earliest is a minimum
        owner = np.repeat(np.arange(len(sizes)), sizes + 1)
        place = start[owner] + np.arange(len(text)) - begin[owner]
        order = np.lexsort((place, doc[owner]))
        level = np.empty(len(text), np.int64)
        step = np.diff(doc[owner][order], prepend=-1) != 0
        step |= np.diff(place[order], prepend=-1) != 0
        level[order] = np.cumsum(step)
        index = FMIndex(text, window, level)
        at, block = index.matching_blocks(text, begin, end)
        at = np.sort(at[index.least[block] < level[at]])
        if not len(at):
            return None
        fresh = np.ones(len(at), bool)
        fresh[1:] = (at[1:] != at[:-1] + 1) | (owner[at[1:]] != owner[at[:-1]])
        head = np.flatnonzero(fresh)
        a, b = at[head], at[np.append(head[1:], len(at)) - 1] + window
        who = owner[a]
        return _cover(grp[who], row[who], start[who] + a - begin[who], start[who] + b - begin[who])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, size, anchor = [], 0, None
        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if r[5] is None:  # already known to be covered: start, and the end in place of the document
                    continue
                if r[0] != anchor and size > index_words:
                    if (out := repeats(unit)) is not None:
                        yield out
                    unit, size = [], 0
                anchor = r[0]
                unit.append(r)
                size += len(r[5]) // 8
            known = batch.filter(pa.compute.is_null(batch.column(5)))
            if known.num_rows:
                yield _cover(known.column(1), known.column(2), known.column(4), known.column(3).cast(pa.int32()))
        if unit and (out := repeats(unit)) is not None:
            yield out

    return run


RESULT = "doc_id bigint, n_words bigint, n_removed bigint, kept_text string, kept_sha256 string"


def remove_repeats(
    docs: DataFrame,
    window: int = WINDOW,
    gram: int = GRAM,
    group_bytes: int = GROUP_BYTES,
    index_words: int = INDEX_WORDS,
    hot: int = HOT,
    with_text: bool = True,
) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_text, kept_sha256`` of every row; no text unless ``with_text``."""
    texts = docs.selectExpr("CAST(doc_id AS bigint) doc_id", "text")
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(1, -(-int(total) // group_bytes))
    grouped = texts.withColumn("grp", F.pmod(F.xxhash64("doc_id"), F.lit(groups)).cast("int"))

    def anchors(table: pa.Table) -> pa.Table:
        grp = table.column("grp")[0].as_py()
        found, count = np.unique(Stretches(table, window, gram).anchor, return_counts=True)
        return pa.table(
            {"anchor": pa.array(found, pa.int64()), "grp": pa.array(np.full(len(found), grp), pa.int32()), "n": pa.array(count, pa.int32())}
        )

    def contents(table: pa.Table, answer: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table({k: pa.array([], t) for k, t in (("content", pa.int64()), ("grp", pa.int32()), ("doc", pa.int64()), ("start", pa.int32()))})
        s = Stretches(table, window, gram)
        suspect = np.flatnonzero(np.isin(s.anchor, _joined(answer.column("yes"))))
        single, owner = s.windows(np.flatnonzero(np.isin(s.anchor, _joined(answer.column("no")))))
        begin = np.concatenate([s.begin[suspect], single])
        content = np.concatenate([s.hashed(s.begin[suspect], s.end[suspect]), s.hashed(single, single + window, _SINGLE)])
        row = s.row[np.concatenate([suspect, owner])]
        doc, start = s.key[row], begin - s.bounds[row]
        first = _firsts(content, doc, start)
        return pa.table(
            {
                "content": pa.array(content[first], pa.int64()),
                "grp": pa.array(np.full(len(first), table.column("grp")[0].as_py()), pa.int32()),
                "doc": pa.array(doc[first], pa.int64()),
                "start": pa.array(start[first], pa.int32()),
            }
        )

    def words(table: pa.Table, answer: pa.Table) -> pa.Table:
        names, kinds = ("anchor", "grp", "row", "doc", "start", "words"), (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary())
        if not table.num_rows:
            return pa.table({k: pa.array([], t) for k, t in zip(names, kinds, strict=True)})
        grp = table.column("grp")[0].as_py()
        s = Stretches(table, window, gram)
        yes, no = _joined(answer.column("yes")), _joined(answer.column("no"))

        def sorted_out(begin: np.ndarray, end: np.ndarray, row: np.ndarray, salt: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """(known, repeated, first of its content) of ranges.  Copies that begin where the first does are rows
            of the same id: not earlier, so not repeats."""
            content = s.hashed(begin, end, salt)
            doc, start = s.key[row], begin - s.bounds[row]
            mine, others = np.isin(content, yes), np.isin(content, no)
            owned = np.flatnonzero(mine)
            owned = owned[_firsts(content[owned], doc[owned], start[owned])]
            _, inverse = np.unique(content, return_inverse=True)
            home = np.full(int(inverse.max(initial=-1)) + 1, -1, np.int64)
            home[inverse[owned]] = owned
            at = home[inverse]
            return mine | others, others | mine & ((doc != doc[at]) | (start != start[at])), mine

        known, repeated, mine = sorted_out(s.begin, s.end, s.row)
        again = np.flatnonzero(mine & ~repeated)
        # stretches of hot anchors were sent window by window
        single, owner = s.windows(np.flatnonzero(~known))
        _, single_repeated, _ = sorted_out(single, single + window, s.row[owner], _SINGLE)
        later = np.flatnonzero(repeated)
        begin = np.concatenate([s.begin[later], single[single_repeated]])
        end = np.concatenate([s.end[later], single[single_repeated] + window])
        row = s.row[np.concatenate([later, owner[single_repeated]])]
        order = np.argsort(begin, kind="stable")
        begin, end, row = begin[order], end[order], row[order]
        # neighbouring repeats of a row become one range of words
        reach = np.maximum.accumulate(end) if len(end) else end
        joins = np.zeros(len(begin), bool)
        joins[1:] = (row[1:] == row[:-1]) & (begin[1:] <= reach[:-1])
        head = np.flatnonzero(~joins)
        tail = np.append(head[1:], len(begin)).astype(np.int64) - 1 if len(begin) else head
        base = s.bounds[row[head]]
        rows = [
            (s.anchor[again], begin[head]),
            (np.full(len(again), grp), np.full(len(head), grp)),
            (s.row[again], row[head]),
            (s.doc[again], reach[tail] - base),
            (s.start[again], begin[head] - base),
        ]
        sent = [_blob(s.words[a:b].view(np.int64)) for a, b in zip(s.begin[again].tolist(), s.end[again].tolist(), strict=True)]
        arrays = [pa.array(np.concatenate(x), t) for x, t in zip(rows, kinds, strict=False)]
        return pa.table([*arrays, pa.array(sent + [None] * len(head), pa.binary())], names=list(names))

    def removal(table: pa.Table, cover: pa.Table) -> pa.Table:
        out: list[list] = [[] for _ in range(5)]
        if table.num_rows:
            ids, raw = table.column("doc_id").to_pylist(), table.column("text").to_pylist()
            order = sorted(range(len(ids)), key=lambda i: (_LAST if ids[i] is None else ids[i], raw[i] or "", raw[i] is None))
            row, begin, end = (cover.column(k).to_numpy() for k in ("row", "begin", "end"))
            by = np.argsort(row, kind="stable")
            row, begin, end = row[by], begin[by], end[by]
            cut = np.searchsorted(row, np.arange(len(order) + 1))
            for k, i in enumerate(order):
                parts = encode(raw[i]).split()
                a, b = cut[k], cut[k + 1]
                kept = parts
                if b > a:
                    change = np.zeros(len(parts) + 1, np.int64)
                    np.add.at(change, begin[a:b], 1)
                    np.add.at(change, end[a:b], -1)
                    kept = [parts[j] for j in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]
                body = b" ".join(kept)
                text = body.decode("utf-8", "surrogatepass") if with_text else None
                for c, v in zip(out, (ids[i], len(parts), len(parts) - len(kept), text, hashlib.sha256(body).hexdigest()), strict=True):
                    c.append(v)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
        return pa.table([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=[x.split()[0] for x in RESULT.split(", ")])

    by_group = grouped.groupBy("grp")
    repeated = by_group.applyInArrow(anchors, "anchor bigint, grp int, n int").repartition("anchor").mapInArrow(tidy(_twice(hot)), ANSWER)
    stretches = by_group.cogroup(repeated.groupBy("grp")).applyInArrow(contents, "content bigint, grp int, doc bigint, start int")
    firsts = stretches.repartition("content").mapInArrow(tidy(_earliest), ANSWER)
    sent = by_group.cogroup(firsts.groupBy("grp")).applyInArrow(words, WORDS)
    cover = sent.repartition("anchor").sortWithinPartitions("anchor", "doc", "start", "row").mapInArrow(tidy(_index_shard(window, index_words)), COVER)
    return by_group.cogroup(cover.groupBy("grp")).applyInArrow(removal, RESULT)
