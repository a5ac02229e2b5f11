"""A hashed maximum-entropy language model with a class-factored softmax, and the unigram base beside it.

Tokens are the words of a text, lower-cased in A-Z, and one end.  The events are the known tokens (those of the
training texts) and one unknown.  The counts of all training tokens are summed over the whole corpus.

Classes.  Tokens are sorted by their last two bytes, then by hash, and cut into ``BRANCHES`` classes of about equal
mass, these into as many classes again, and so on down to single tokens, so that a frequent token is reached in
one or two steps.  The unknown is a branch of the first step of its own.  With c the count of a token, ``DISCOUNT``
of each type's count is the unknown's mass.  At most ``HEAD_LIMIT`` tokens, the most frequent, are symbols of
their own; the others are gathered by ending and hash in at most ``TAIL_LIMIT`` further symbols, inside which they
share by c.  So what is broadcast is bounded, and every token has a path of softmaxes.
  P(token | history) = product over the path of P(branch | node, history), times c / (count of the symbol)

Features.  At every node P(branch | node, history) is a softmax over the node's log shares by counts plus one
weight vector per feature of the history: the token before, the one before that (skip), both (n-gram), and the
endings of the three before.  Feature values are hashed to the rows that the node has, in number by its mass.
Nodes under ``LEAST_MASS`` tokens keep the shares by counts.

Training.  A round sums, over every place of every training text and for each weight, how often the branch was taken
(O) and how often the model expects it (E): the gradient of the log likelihood is O - E.  All tasks use the same
weights and only sums leave them, so the result doesn't depend on how the texts are split.  The step is
``rate`` * (log(O + PRIOR p) - log(E + PRIOR p)), the gradient scaled by a positive amount for each weight, p being
the share by counts.  In the first round, from weights of zero, E is p times the row's visits exactly, as a
row belongs to one node.  O is summed in whole 16ths.

Null and empty texts are one end; repeated rows are scored alike, each with its own row id in the join; without
training texts N = V = 0 and every token is unknown; an empty table gives an empty one; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, over_batches, slices, tidy
from .wordhash import _SPACE, encode, mix, word_hashes

BRANCHES, BITS = 16, 4
HEAD_LIMIT, TAIL_LIMIT = 524_288, 262_144
ROWS_LIMIT = 262_144  # rows a feature that nodes share by mass, at most (16 MB)
TOKENS_A_ROW = 12
LEAST_MASS = 24
FEATURES = 4
DISCOUNT, PRIOR = 0.6, 30.0
UNIT = 16
BLOCK = 32_768  # places at once
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_ENDING = np.uint64(52)
_NONE = np.float32(-60.0)  # log share of a branch that nothing takes
END = np.uint64(0xFFF0E4D0E4D0E4D0)


def tokens(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(token hashes, the high bits telling the last two bytes; where each text begins), each text closed by ``END``."""
    parts = [encode(x).lower() for x in texts]
    words, cut = word_hashes(parts)
    raw = np.frombuffer(b" ".join([*parts, b""]), np.uint8)
    ends = np.flatnonzero(np.diff(_SPACE[raw].astype(np.int8), prepend=1) == 1)
    ends = ends[ends > 0]
    six = np.uint64(63)
    last = raw[ends - 1].astype(np.uint64) & six
    before = np.where(_SPACE[raw[ends - 2]], 0, raw[ends - 2]).astype(np.uint64) & six
    words = (words >> np.uint64(12)) | (last << np.uint64(58)) | (before << _ENDING)
    sizes = np.diff(cut)
    starts = np.concatenate([[0], np.cumsum(sizes + 1)])
    out = np.full(len(words) + len(texts), END, np.uint64)
    inside = np.ones(len(out), bool)
    inside[starts[1:] - 1] = False
    out[inside] = words
    return out, starts


COUNTS = "token bigint, n bigint"


def count_tokens(texts: DataFrame) -> DataFrame:
    """``token, n`` over all rows; each task sums up what it reads, some million tokens at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def summed(held: list[np.ndarray]) -> pa.RecordBatch:
            token, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(n, pa.int64())], ["token", "n"])

        held, size = [], 0
        for batch in batches:
            column = batch.column(0).to_pylist()
            for a, b in slices(column, 4000, 2_000_000):
                held.append(tokens(column[a:b])[0])
                size += len(held[-1])
                if size > 8_000_000:
                    yield summed(held)
                    held, size = [], 0
        if held:
            yield summed(held)

    return texts.select("text").mapInArrow(tidy(run), COUNTS).groupBy("token").agg(F.sum("n").alias("n"))


@dataclass
class Symbols:
    """What tokens are to the tree: the frequent ones each a symbol, the others by bucket of ending and hash."""

    token: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))  # frequent, sorted
    count: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    own: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))  # symbol of each frequent token
    bits: np.ndarray = field(default_factory=lambda: np.zeros(4096, np.uint64))  # hash bits of a bucket, by ending
    first: np.ndarray = field(default_factory=lambda: np.zeros(4096, np.int64))  # first bucket, by ending
    shared: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))  # symbol of each bucket, or -1
    size: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # tokens of each bucket
    table: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))  # place of a frequent token by its hash

    def index(self) -> None:
        """A table of hash prefixes; tokens that it doesn't lead to are searched for."""
        if len(self.token):
            self.table = np.zeros(1 << max(8, (4 * len(self.token)).bit_length()), np.int32)
            self.table[self._slot(self.token)] = np.arange(len(self.token), dtype=np.int32)

    def _slot(self, token: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((token * _GOLD) >> np.uint64(64 - (len(self.table).bit_length() - 1))).astype(np.int64)

    def find(self, token: np.ndarray) -> np.ndarray:
        """Row of each token among the frequent, or -1."""
        if not len(self.token):
            return np.full(len(token), -1, np.int32)
        at = self.table.take(self._slot(token))
        wrong = np.flatnonzero(self.token.take(at) != token)
        if len(wrong):
            there = np.minimum(np.searchsorted(self.token, token[wrong]), len(self.token) - 1)
            at[wrong] = np.where(self.token[there] == token[wrong], there, -1)
        return at

    def bucket(self, token: np.ndarray) -> np.ndarray:
        ending = (token >> _ENDING).astype(np.int64)
        bits = self.bits[ending]
        inside = (token & np.uint64((1 << 52) - 1)) >> (np.uint64(52) - bits)
        return self.first[ending] + inside.astype(np.int64)

    def symbol(self, token: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Symbol of each token, -1 if only the unknown is left for it; ``at`` as ``find`` gives it."""
        out = self.own.take(np.maximum(at, 0)) if len(self.own) else np.full(len(token), -1, np.int32)
        rest = np.flatnonzero(at < 0)
        if len(rest):
            out[rest] = self.shared[self.bucket(token[rest])] if len(self.shared) else -1
        return out


@dataclass
class Tree:
    """Nodes of ``BRANCHES`` branches; node 0 is the first step, its last branch the unknown."""

    code: np.ndarray  # branches of each symbol's path, ``BITS`` each, the first lowest
    child: np.ndarray  # node below each branch, or -1
    share: np.ndarray  # log share of each branch by counts
    base: np.ndarray  # (feature 0, the others) x nodes: first row of each node; row 0 stays zero for the others
    size: np.ndarray  # the same: how many rows
    rows: tuple[int, int]

    def shares_by_row(self, other: int) -> np.ndarray:
        """Node of each row, of feature 0 or of the others."""
        out = np.zeros(self.rows[other], np.int64)
        own = np.flatnonzero((self.base[other] > 0) | (other == 0))
        out[np.repeat(self.base[other][own], self.size[other][own]) + _within(self.size[other][own])] = np.repeat(own, self.size[other][own])
        return out


def _within(sizes: np.ndarray) -> np.ndarray:
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


@dataclass
class Model:
    symbols: Symbols
    tree: Tree
    weights: list[np.ndarray]  # a feature: rows x BRANCHES; as ``Parcel.open`` gives them, feature 0 has the log shares added
    gone: np.ndarray  # of each symbol, how much of a use, in ``UNIT`` ths, counts for the unknown


class Parcel:
    """A model on its way to the tasks: no index, narrow numbers, weights in half precision beside the log shares."""

    def __init__(self, model: Model, weights: bool):
        tree = model.tree
        self.symbols = replace(model.symbols, table=model.symbols.table[:0])
        self.tree = replace(tree, base=tree.base.astype(np.int32), size=tree.size.astype(np.int32), share=tree.share if weights else tree.share[:0])
        self.gone = model.gone
        self.weights = [w.astype(np.float16) for w in model.weights] if weights else []
        self.model: Model | None = None

    def open(self) -> Model:
        """The model, made once a worker."""
        if self.model is None:
            self.symbols.index()
            tree = replace(self.tree, base=self.tree.base.astype(np.int64), size=self.tree.size.astype(np.int64))
            weights = [w.astype(np.float32) for w in self.weights]
            if weights:
                weights[0] += tree.share[tree.shares_by_row(0)]
            self.weights = []
            self.model = Model(self.symbols, tree, weights, self.gone)
        return self.model


def grow_tree(mass: np.ndarray, unknown: float, rows_limit: int = ROWS_LIMIT, tokens_a_row: int = TOKENS_A_ROW) -> Tree:
    """Cut symbols in their order into classes of about equal mass, level by level."""
    code = np.zeros(len(mass), np.int64)
    live, group, nodes, level = np.arange(len(mass)), np.zeros(len(mass), np.int64), 0, 0
    children, masses = [], []
    while len(live) or not level:
        m = mass[live]
        head = np.flatnonzero(np.diff(group, prepend=-1))
        of = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(live))))
        sums = np.cumsum(m)
        whole = np.add.reduceat(m, head) if len(head) else np.zeros(1)
        n = max(1, len(head))
        width = BRANCHES - (level == 0)
        before = sums - m / 2 - (sums[head] - m[head])[of]
        digit = np.minimum((before / whole[of] * width).astype(np.int64), width - 1)
        code[live] |= digit << (BITS * level)
        key = of * BRANCHES + digit
        cut = np.flatnonzero(np.diff(key, prepend=-1))
        count = np.diff(np.append(cut, len(live)))
        table = np.zeros(n * BRANCHES)
        table[key[cut]] = np.add.reduceat(m, cut) if len(cut) else 0
        if level == 0:
            table[BRANCHES - 1] = max(unknown, 1e-9)
        child = np.full(n * BRANCHES, -1, np.int32)
        many = cut[count > 1]
        child[key[many]] = nodes + n + np.arange(len(many))
        children.append(child)
        masses.append(table.reshape(-1, BRANCHES))
        nodes += n
        stay = np.repeat(count > 1, count)
        live, key = live[stay], key[stay]
        group = np.cumsum(np.diff(key, prepend=-1) != 0) - 1
        level += 1
    table = np.concatenate(masses)
    whole = table.sum(1)
    with np.errstate(divide="ignore"):
        share = np.where(table > 0, np.log(table / whole[:, None]), _NONE).astype(np.float32)
    some = whole >= LEAST_MASS
    rows = min(rows_limit, max(4096, int(whole[0] / tokens_a_row)))
    size = np.ones((2, nodes), np.int64)
    size[:, some] = np.maximum(1, np.round(rows * whole[some] / max(whole[some].sum(), 1)))
    base = np.cumsum(size, axis=1) - size
    first = int(size[0].sum())
    size[1, ~some] = 0
    base[1] = np.where(some, 1 + np.cumsum(size[1]) - size[1], 0)
    return Tree(code, np.concatenate(children), share, base, size, (first, 1 + int(size[1].sum())))


def features(token: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Feature hashes (FEATURES x places, 32 bits) of each place's history; places before a text count as ``END``."""
    n = len(token)
    inside = np.arange(n) - np.repeat(starts[:-1], np.diff(starts))
    back = []
    for k in (1, 2, 3):
        x = np.full(n, END, np.uint64)
        x[k:] = token[:-k] if n > k else x[k:]
        back.append(np.where(inside >= k, x, END))
    a, b, c = back
    out = np.empty((FEATURES, n), np.uint64)
    with np.errstate(over="ignore"):
        out[0] = mix(a + np.uint64(1))
        out[1] = mix(b * np.uint64(3) + np.uint64(2))
        out[2] = mix(a * _GOLD + b)
        out[3] = mix((((a >> _ENDING) << np.uint64(24)) | ((b >> _ENDING) << np.uint64(12)) | (c >> _ENDING)) + np.uint64(7))
    return (out >> np.uint64(32)).view(np.int64)


def steps(tree: Tree, hashed: np.ndarray, code: np.ndarray) -> Iterator[tuple[np.ndarray | None, np.ndarray, np.ndarray, list[np.ndarray]]]:
    """(places, or None for all; node; branch taken; weight row of each feature) of each step down the tree."""
    at, node = None, np.zeros(len(code), np.int32)
    while len(code):
        branch = code & (BRANCHES - 1)
        rows = []
        for k in range(FEATURES):
            x = hashed[k] if at is None else hashed[k].take(at)
            base, size = tree.base[int(k > 0)], tree.size[int(k > 0)]
            rows.append((x * size.take(node) >> 32) + base.take(node))
        yield at, node, branch, rows
        below = tree.child.take(node * BRANCHES + branch)
        go = np.flatnonzero(below >= 0)
        at = go if at is None else at.take(go)
        node, code = below.take(go), code.take(go) >> BITS


_ONES = np.ones(BRANCHES, np.float32)


def _exp_logits(weights: list[np.ndarray], rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Logits of each place, and their exponentials; steps keep logits far from overflow."""
    z = weights[0].take(rows[0], axis=0)
    for w, r in zip(weights[1:], rows[1:], strict=True):
        z += w.take(r, axis=0)
    return z, np.exp(z)


def log_probs(model: Model, hashed: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Natural log of the probability of each place's path, and of the unknown there."""
    out, unknown = np.zeros(len(code)), np.zeros(len(code))
    for a in range(0, len(code), BLOCK):
        part = slice(a, a + BLOCK)
        total = np.zeros(len(code[part]), np.float32)
        for at, _, branch, rows in steps(model.tree, hashed[:, part], code[part]):
            z, e = _exp_logits(model.weights, rows)
            norm = np.log(e @ _ONES)
            taken = z.ravel().take(np.arange(0, z.size, BRANCHES) + branch) - norm
            if at is None:
                total += taken
                unknown[part] = z[:, -1] - norm
            else:
                total[at] += taken
        out[part] = total
    return out, unknown


def gradient_sums(model: Model, parts: Iterator[tuple[np.ndarray, np.ndarray]], expected: bool) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """(O in ``UNIT`` ths, E in uses) of each feature's weights over token arrays; without ``expected`` no E."""
    tree = model.tree
    taken = [np.zeros(tree.rows[k > 0] * BRANCHES, np.uint32) for k in range(FEATURES)]
    hoped = [np.zeros(tree.rows[k > 0] * BRANCHES, np.float64) for k in range(FEATURES if expected else 0)]
    ar = np.arange(BRANCHES)
    for token, starts in parts:
        hashed = features(token, starts)
        symbol = model.symbols.symbol(token, model.symbols.find(token))
        code, gone = tree.code[symbol], model.gone[symbol]
        for a in range(0, len(token), BLOCK):
            part = slice(a, a + BLOCK)
            lost = gone[part]
            for at, _, branch, rows in steps(tree, hashed[:, part], code[part]):
                n = UNIT - (lost if at is None else lost.take(at))
                for k in range(FEATURES):
                    np.add.at(taken[k], rows[k] * BRANCHES + branch, n)
                    if at is None:
                        some = np.flatnonzero(lost)
                        np.add.at(taken[k], rows[k][some] * BRANCHES + BRANCHES - 1, lost[some])
                if expected:
                    _, e = _exp_logits(model.weights, rows)
                    p = e / (e @ _ONES)[:, None] * (1.0 if at is None else n[:, None] / UNIT)
                    for k in range(FEATURES):
                        np.add.at(hoped[k], (rows[k][:, None] * BRANCHES + ar).ravel(), p.ravel().astype(np.float64))
    return taken, hoped


def step(taken: np.ndarray, hoped: np.ndarray, share: np.ndarray, rate: float, prior: float = PRIOR) -> np.ndarray:
    """The change of weights (rows x branches): O - E, scaled; none where the share by counts is nothing."""
    p = np.exp(share, dtype=np.float64) * prior
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(share > _NONE, rate * (np.log(taken + p) - np.log(hoped + p)), 0.0).astype(np.float32)


_CHUNK = 4096  # rows of weights in a message
SUMS = "chunk int, body binary"


def train_round(texts: DataFrame, model: Model, rate: float, first: bool) -> Model:
    """One round over every place of all texts: sums of O (and E), then one step of all weights."""
    context = texts.sparkSession.sparkContext
    tree = model.tree
    shared = context.broadcast(Parcel(model, not first))
    shares = context.broadcast(replace(tree, code=tree.code[:0], child=tree.child[:0]))
    kinds = np.uint32, np.float64
    wide = _CHUNK * BRANCHES
    thin = texts.select("text")
    splits = thin.rdd.getNumPartitions()
    # a task's sums are as large however little it reads, so small splits are read together, eight at most
    thin = thin.coalesce(max(1, -(-splits // 8), min(splits, 2 * context.defaultParallelism)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts():
            for batch in batches:
                column = batch.column(0).to_pylist()
                for a, b in slices(column, 4000, 2_000_000):
                    yield tokens(column[a:b])

        for kind, tables in enumerate(gradient_sums(shared.value.open(), parts(), not first)):
            for k, table in enumerate(tables):
                for a in range(0, len(table), wide):
                    part = table[a : a + wide]
                    if part.any():
                        number = (k * 1000 + a // wide) * 2 + kind
                        body = pa.compress(part.tobytes(), "zstd", asbytes=True)
                        yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([body], pa.binary())], ["chunk", "body"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums per chunk, as large as the weights however many come in, then the step of each chunk."""
        tree = shares.value
        sums: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for number, body in zip(batch.column(0), batch.column(1), strict=True):
                chunk, kind = divmod(number.as_py(), 2)
                k, a = divmod(chunk, 1000)
                size = min(wide, tree.rows[k > 0] * BRANCHES - a * wide)
                values = np.frombuffer(pa.decompress(body.as_buffer(), size * np.dtype(kinds[kind]).itemsize, "zstd"), kinds[kind])
                both = sums.setdefault(chunk, [np.zeros(len(values), np.int64), np.zeros(0 if first else len(values))])
                both[kind] += values
        node = {other: tree.shares_by_row(other) for other in (0, 1)}
        for chunk, (taken, hoped) in sums.items():
            k, a = divmod(chunk, 1000)
            share = tree.share[node[k > 0][a * _CHUNK : (a + 1) * _CHUNK]]
            o = taken.reshape(-1, BRANCHES) / UNIT
            e = o.sum(1, keepdims=True) * np.exp(share, dtype=np.float64) if first else hoped.reshape(-1, BRANCHES)
            body = step(o, e, share, rate).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([body], pa.binary())], ["chunk", "body"])

    changes = thin.mapInArrow(tidy(run), SUMS).repartition(F.floor(F.col("chunk") / 2)).mapInArrow(tidy(add), SUMS)
    weights = [w.copy() for w in model.weights]
    table = changes.toArrow()  # as large as the weights
    for number, body in zip(table.column("chunk"), table.column("body"), strict=True):
        k, a = divmod(number.as_py(), 1000)
        change = np.frombuffer(body.as_buffer(), np.float32).reshape(-1, BRANCHES)
        weights[k][a * _CHUNK : a * _CHUNK + len(change)] += change
    for w in weights[1:]:
        w[0] = 0  # the row of nodes without rows
    shared.destroy()
    shares.destroy()
    return Model(model.symbols, tree, weights, model.gone)


def _level() -> F.Column:
    return F.floor(F.log2("n") * 16).cast("int")


def head_level(counts: DataFrame, limit: int) -> int | None:
    """The least level of counts from which on at most ``limit`` tokens are left."""
    least, total = None, 0
    for r in sorted(counts.groupBy(_level().alias("level")).count().collect(), reverse=True):
        total += r["count"]
        if total > limit:
            break
        least = r["level"]
    return least


def gather_tail(tail: DataFrame, symbols: Symbols, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Sets the buckets of ``symbols`` for the tokens of ``tail``; returns the buckets' tokens and types."""
    ending = F.shiftrightunsigned(F.col("token"), 52).cast("int")
    types = np.zeros(4096, np.int64)
    for r in tail.groupBy(ending.alias("ending")).count().collect():
        types[r["ending"]] = r["count"]
    share = np.floor(np.log2(np.maximum(1.0, types * (limit - 4096) / max(types.sum(), 1)))).astype(np.int64)
    symbols.bits = np.minimum(share, 20).astype(np.uint64)
    sizes = 1 << symbols.bits.astype(np.int64)
    symbols.first = np.cumsum(sizes) - sizes
    plain = Symbols(bits=symbols.bits, first=symbols.first)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bucket = plain.bucket(batch.column(0).to_numpy().view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int64()), batch.column(1)], ["bucket", "n"])

    rows = tail.mapInArrow(tidy(run), "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v"))
    n, v = np.zeros(int(sizes.sum()), np.int64), np.zeros(int(sizes.sum()), np.int64)
    table = rows.toArrow()
    at = table.column("bucket").to_numpy()
    n[at], v[at] = table.column("n").to_numpy(), table.column("v").to_numpy()
    return n, v


def start_model(counts: DataFrame, head_limit: int = HEAD_LIMIT, tail_limit: int = TAIL_LIMIT) -> tuple[Model, int, int, int | None]:
    """The symbols and the tree, with weights of zero; all tokens, all types, and the level under which counts are in buckets."""
    totals = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    least = head_level(counts, head_limit)
    symbols = Symbols()
    if least is not None:
        table = counts.where(_level() >= least).toArrow()
        token = table.column("token").to_numpy().view(np.uint64)
        order = np.argsort(token)
        symbols.token, symbols.count = token[order], table.column("n").to_numpy()[order]
    tail_n = tail_v = np.zeros(0, np.int64)
    rest = totals["v"] > len(symbols.token)
    if rest:
        tail = counts if least is None else counts.where(_level() < least)
        tail_n, tail_v = gather_tail(tail, symbols, tail_limit)
    some = np.flatnonzero(tail_v)
    ending = np.repeat(np.arange(4096, dtype=np.uint64), 1 << symbols.bits.astype(np.int64))[: len(tail_v)]
    place = (np.arange(len(ending)) - symbols.first[ending.astype(np.int64)]).astype(np.uint64)
    low = (ending << _ENDING) | (place << (np.uint64(52) - symbols.bits[ending.astype(np.int64)]))
    order = np.argsort(np.concatenate([symbols.token, low[some]]), kind="stable")
    n = np.concatenate([symbols.count, tail_n[some]])[order].astype(float)
    v = np.concatenate([np.ones(len(symbols.token)), tail_v[some]])[order]
    back = np.empty(len(order), np.int32)
    back[order] = np.arange(len(order), dtype=np.int32)
    symbols.own, symbols.size = back[: len(symbols.token)], tail_n
    symbols.shared = np.full(len(tail_v), -1, np.int32)
    symbols.shared[some] = back[len(symbols.token) :]
    symbols.index()
    tree = grow_tree(n - DISCOUNT * v, DISCOUNT * totals["v"])
    weights = [np.zeros((tree.rows[k > 0], BRANCHES), np.float32) for k in range(FEATURES)]
    gone = np.round(UNIT * DISCOUNT * v / np.maximum(n, 1)).astype(np.uint32)
    return Model(symbols, tree, weights, gone), totals["n"], totals["v"], least if rest else None


@dataclass
class Fitted:
    """A trained model with what scoring needs beside it."""

    model: Model
    n: int
    v: int
    tail: DataFrame | None  # ``token, n`` of the tokens that are no symbol of their own


def fit(texts: DataFrame, rounds: int = 1, rate: float = 0.55, later: float = 0.25, head_limit: int = HEAD_LIMIT, tail_limit: int = TAIL_LIMIT) -> Fitted:
    """Counts over all texts, then ``rounds`` synchronous rounds, each over every place of every text."""
    if rounds < 1:
        raise ValueError("no round, no weights")
    counts = materialise(count_tokens(texts), "counts")
    model, n, v, least = start_model(counts, head_limit, tail_limit)
    if n:
        for r in range(rounds):
            model = train_round(texts, model, later if r else rate, not r)
    tail = None
    if v > len(model.symbols.token):
        tail = counts if least is None else counts.where(_level() < least)
    return Fitted(model, n, v, tail)


PART = "part_id bigint, doc_id bigint, n_tokens bigint, n_known bigint, base double, score double, rare array<bigint>, shared array<float>, lost array<float>"


def score(docs: DataFrame, fitted: Fitted) -> DataFrame:
    """``doc_id, n_tokens, n_known, train_tokens, base_score, score`` of every row.

    A token that is no symbol of its own is looked up among the counts by a join: if it is there it gets its share of
    its bucket's symbol, else it is the unknown; the text brings the logs of both.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Parcel(fitted.model, True))
    complete = fitted.tail is None

    def make():
        m = shared.value.open()
        s = m.symbols
        known_base = np.append(np.log10(s.count + 0.5), np.log10(0.5))
        size = np.log10(np.maximum(s.size, 1))

        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = batch.column(2).to_pylist()
            n, known, base, total, rare, inside, lost = [], [], [], [], [], [], []
            for a, b in slices(texts, 4000, 1_000_000):
                token, starts = tokens(texts[a:b])
                at = s.find(token)
                symbol = s.symbol(token, at)
                code = m.tree.code.take(np.maximum(symbol, 0)) if len(m.tree.code) else np.zeros(len(token), np.int64)
                code[symbol < 0] = BRANCHES - 1
                own, unknown = (x / np.log(10) for x in log_probs(m, features(token, starts), code))
                found = at >= 0
                first = known_base.take(at)
                if not complete:
                    missing = np.flatnonzero(~found)
                    paths = own[missing]
                    own[missing] = first[missing] = 0.0
                n += np.diff(starts).tolist()
                known += np.add.reduceat(found.astype(np.int64), starts[:-1]).tolist()
                base += np.add.reduceat(first, starts[:-1]).tolist()
                total += np.add.reduceat(own, starts[:-1]).tolist()
                if complete:
                    continue
                cut = np.searchsorted(missing, starts)
                word = token[missing]
                part = (paths - size[s.bucket(word)]).astype(np.float32)
                none = unknown[missing].astype(np.float32)
                for x, y in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                    rare.append(word[x:y].view(np.int64))
                    inside.append(part[x:y])
                    lost.append(none[x:y])
            columns = [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(total, pa.float64())]
            if not complete:
                columns += [pa.array(rare, pa.list_(pa.int64())), pa.array(inside, pa.list_(pa.float32())), pa.array(lost, pa.list_(pa.float32()))]
            return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in schema.split(", ")])

        return f

    schema = ", ".join(PART.split(", ")[: 6 if complete else 9])
    rows = docs.select(F.monotonically_increasing_id().alias("part_id"), F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    whole = over_batches(rows, make, schema)
    more = {"n_known": F.lit(0), "base": F.lit(0.0), "score": F.lit(0.0)}
    if not complete:
        parts = materialise(whole, "scored")
        rare = parts.select("part_id", F.inline(F.arrays_zip("rare", "shared", "lost"))).withColumnRenamed("rare", "token")
        joined = rare.join(fitted.tail, "token", "left")
        terms = joined.groupBy("part_id").agg(
            F.count("n").alias("more_known"),
            F.sum(F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("more_base"),
            F.sum(F.when(F.col("n").isNull(), F.col("lost")).otherwise(F.log10("n") + F.col("shared"))).alias("more_score"),
        )
        whole = parts.drop("rare", "shared", "lost").join(terms, "part_id", "left")
        more = {k: F.coalesce(f"more_{k.removeprefix('n_')}", F.lit(0)) for k in more}
    scale = float(np.log10(fitted.n + 0.5 * (fitted.v + 1)))
    return whole.select(
        "doc_id",
        "n_tokens",
        (F.col("n_known") + more["n_known"]).cast("bigint").alias("n_known"),
        F.lit(fitted.n).cast("bigint").alias("train_tokens"),
        (F.col("base") + more["base"] - F.col("n_tokens") * scale).alias("base_score"),
        (F.col("score") + more["score"]).alias("score"),
    )
