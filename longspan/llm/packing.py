"""Best-fit packing of token sequences by the sum-of-squares rule.

Texts become ids of a public tokenizer followed by an end id.  Only documents longer than the
capacity are cut.  A placer keeps N(g), the number of open bins with g free places, and puts a
piece where the sum of N(g) squared grows least (a new bin counts as a gap of the whole capacity).
Shards hold a bounded number of pieces, chosen by a hash, so one task never sees all documents and
a hot source spreads evenly; each shard packs on its own, and its state is N and the open bins.
Pieces of exactly the capacity open and close a bin of their own.

Defined results: a null or empty text is one end id (length 1); repeated rows are packed once each;
an empty table gives an empty one; further columns of the input are ignored.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Callable, Iterator
from itertools import compress, pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, over_batches, slices

CAPACITY = 4096
END_ID = 1
SHARD_PIECES = 200_000
CACHE_WORDS, BATCH_CHARS = 500_000, 8_000_000

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
PACKED = PIECES + ", sequence_id bigint, offset bigint"


class ChunkTokenizer:
    """Ids of whole texts as little-endian uint32 bytes, cached by blank-separated chunk and by word.

    The vocabulary's pre-tokenizer never joins characters across white space, so the ids of a text are those of
    its chunks put together; inside a chunk it cuts words that are coded alone, the last id of each marked as a
    word's end.  Arrow finds the different chunks of a batch, and the different words of its new chunks, and puts
    their ids together again, so only what differs becomes Python objects.  New words are given many at a time to
    the tokenizer's model, already cut and normalised, and their ids cut at those marks.  Chunks with characters
    beyond Latin-1, with control characters or with a special token's text go to the tokenizer whole, which leaves
    all Unicode rules and special tokens to it.  Each cache keeps at most ``limit`` entries; what comes later is
    coded for its batch only.
    """

    def __init__(self, path: str, limit: int = CACHE_WORDS, batch_chars: int = BATCH_CHARS):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            parts = json.load(f)
        self.model = Tokenizer.from_str(json.dumps(parts | {"normalizer": None, "pre_tokenizer": None, "added_tokens": []}))
        self.special = [x["content"] for x in parts["added_tokens"]]
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for x, i in vocab.items() if x.endswith("</w>")]] = True
        self.limit, self.batch_chars = limit, batch_chars
        self.chunks: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {"\n": b""}  # stands after each new chunk

    def _coded(self, words: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for at in range(0, len(words), 20_000):
            part = words[at : at + 20_000]
            bare = [w if w.isascii() else w.encode().decode("latin-1").translate(_BYTES) for w in part]
            ids = np.array(self.model.encode_batch_fast([bare], is_pretokenized=True, add_special_tokens=False)[0].ids, "<u4")
            cuts = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            if len(cuts) != len(part):
                raise ValueError("the vocabulary doesn't mark the end of each word")
            raw = ids.tobytes()
            out += [raw[a:b] for a, b in pairwise([0, *cuts])]
        return out

    def _joined(self, parts: pa.Array, cache: dict[str, bytes], code: Callable[[list[str]], list[bytes]]) -> tuple[np.ndarray, memoryview]:
        """Where the ids of each part begin, and those of all parts; ``code`` makes what the cache lacks."""
        if not len(parts):
            return np.zeros(1, np.int64), memoryview(b"")
        found = parts.dictionary_encode()
        names = found.dictionary.to_numpy(zero_copy_only=False).tolist()  # faster than to_pylist
        ids = list(map(cache.get, names))
        new = [i for i, x in enumerate(ids) if x is None]
        for i, x in zip(new, code([names[i] for i in new]), strict=True):
            ids[i] = x
        cache.update((names[i], ids[i]) for i in new[: max(0, self.limit - len(cache))])
        _, places, data = pa.array(ids, pa.large_binary()).take(found.indices).buffers()
        return np.frombuffer(places, np.int64, len(parts) + 1), memoryview(data or b"")

    def _learn(self, chunks: list[str]) -> list[bytes]:
        """The ids of new chunks."""
        plain = [_PLAIN(x) is not None for x in chunks]
        text = "\n".join(chunks)
        if any(s in text for s in self.special):
            plain = [p and not any(s in x for s in self.special) for p, x in zip(plain, chunks, strict=True)]
        words = pa.array(_WORDS("".join(x + "\n" for x in compress(chunks, plain)).lower()), pa.large_string())
        at, ids = self._joined(words, self.words, self._coded)
        cuts = at[:-1][pc.equal(words, "\n").to_numpy(zero_copy_only=False)].tolist()
        cut = (bytes(ids[a:b]) for a, b in pairwise([0, *cuts]))
        odd = iter(self.tokenizer.encode_batch_fast([x for p, x in zip(plain, chunks, strict=True) if not p], add_special_tokens=False))
        return [next(cut) if p else np.array(next(odd).ids, "<u4").tobytes() for p in plain]

    def __call__(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text, without an end id."""
        for a, b in slices(texts, 4000, self.batch_chars):
            parts = pc.split_pattern(pa.array([_blanks(x) for x in texts[a:b]], pa.large_string()), " ")
            at, ids = self._joined(parts.flatten(), self.chunks, self._learn)
            for x, y in pairwise(at[parts.offsets.to_numpy()].tolist()):
                yield bytes(ids[x:y])


def _blanks(text: str) -> str:
    for c in "\n\t\r\x0b\x0c":
        text = text.replace(c, " ")
    return text


_PLAIN = re.compile(r"[!-~\xa1-\xff]*").fullmatch
#: The characters that the vocabulary's byte alphabet has for bytes 0x80 to 0xFF, with which words beyond ASCII are written.
_BYTES: dict[int, int] = {**{i: 0x121 + i - 0x7F for i in range(0x7F, 0xA1)}, 0xAD: 0x143}
_L, _N = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe"
_WORDS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|\n|[^{_L}{_N}\n]+").findall


_TOKENIZERS: dict[str, ChunkTokenizer] = {}


def tokenizer_of(path: str, limit: int, batch_chars: int) -> ChunkTokenizer:
    """One per Python worker, so that later tasks of the worker find its cache."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = ChunkTokenizer(path, limit, batch_chars)
    return _TOKENIZERS[path]


def pieces(
    docs: DataFrame,
    tokenizer_path: str,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    cache_words: int = CACHE_WORDS,
    batch_chars: int = BATCH_CHARS,
) -> DataFrame:
    """One row per piece of at most ``capacity`` ids, with the checksum of its ids.

    ``cache_words`` bounds what a worker keeps coded (about 250 bytes each) and ``batch_chars`` what it codes at
    once (about 12 bytes a character); results depend on neither.
    """

    def make():
        encode = tokenizer_of(tokenizer_path, cache_words, batch_chars)
        end = np.array([end_id], "<u4").tobytes()

        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows: list[tuple] = []
            texts = [x or "" for x in batch.column(1).to_pylist()]
            for doc_id, ids in zip(batch.column(0).to_pylist(), encode(texts), strict=True):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            names = [x.split()[0] for x in PIECES.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        return f

    return over_batches(docs.selectExpr("CAST(doc_id AS bigint) doc_id", "text"), make, PIECES, max(1_000, batch_chars // 800))


def sum_of_squares(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Bin number and offset of each length, placed in the order given.

    With N(g) open bins of gap g, moving one from g to h = g - length changes the sum of squares by
    2 (N(h) - N(g)) + 2, without the terms of h if the bin is then full; a new bin only adds its gap.  Ties go
    to the smallest gap.  Bins of a gap are reused last in, first out.
    """
    n = np.zeros(capacity + 1, np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    count = 0
    for i, size in enumerate(lengths.tolist()):
        there = n[size:capacity]  # gaps size .. capacity - 1
        change = 2 * (n[: capacity - size] - there) + 2
        if size < capacity:
            change[0] = 1 - 2 * there[0]
            change[there == 0] = np.iinfo(np.int64).max
            k = int(change.argmin())
            fresh = 2 * int(n[capacity - size]) + 1
        if size < capacity and there[k] and change[k] <= fresh:
            gap = size + k
            b = open_bins[gap].pop()
            n[gap] -= 1
        else:
            gap, b = capacity, count
            count += 1
        bins[i], offsets[i] = b, capacity - gap
        if gap > size:
            open_bins[gap - size].append(b)
            n[gap - size] += 1
    return bins, offsets


def pack(parts: DataFrame, capacity: int = CAPACITY, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Assign ``sequence_id`` and ``offset`` to the rows of ``pieces``."""
    parts = materialise(parts, "pieces")
    shards = max(1, -(-parts.count() // shard_pieces))

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "piece", "start"], ascending=[False, True, True, True], kind="stable")
        bins, offsets = sum_of_squares(pdf["length"].to_numpy(), capacity)
        return pdf.drop(columns="shard").assign(sequence_id=bins + (int(pdf["shard"].iloc[0]) << 40), offset=offsets)

    sharded = parts.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(shards)).cast("long"))
    return sharded.groupBy("shard").applyInPandas(place, PACKED)
