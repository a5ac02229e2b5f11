import collections
import hashlib
import math
import random
import tracemalloc
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from longspan.llm import decontam, lm, media, neardup, packing, registry, substring
from longspan.llm.common import over_batches
from longspan.llm.fmindex import Bits, FMIndex, WaveletMatrix
from longspan.llm.graph import components
from longspan.llm.q_packing import tokenizer_path
from longspan.llm.wordhash import encode, word_hashes
from tests.helpers import SF
from tests.llm.frames import ROWS, documents, empty

RND = random.Random(11)


def passages(n=60, seed=7):
    """Texts with shared passages, copies, near copies and repeats inside one text."""
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(40)]
    shared = [[rnd.choice(words) for _ in range(30)] for _ in range(4)]
    rows = []
    for i in range(n):
        text = [rnd.choice(words) for _ in range(rnd.randint(0, 60))]
        for _ in range(rnd.randint(0, 3)):
            s = rnd.choice(shared)
            a = rnd.randrange(10)
            text[rnd.randint(0, len(text)) : 0] = s[a : a + rnd.randint(5, 30)]
        if i % 7 == 0 and rows:
            text = list(rows[-1][1].split())
            if i % 2 and text:
                text[rnd.randrange(len(text))] = "changed"
        rows.append((i, " ".join(text), "en"))
    return rows


def test_word_hashes():
    texts = [b"", b" a  bb\tbb ", b"\n", "né né".encode(), b"a" * 5000 + b" b"]
    hashes, cut = word_hashes(texts)
    names = [w for t in texts for w in t.split()]
    assert np.diff(cut).tolist() == [len(t.split()) for t in texts]
    assert len(set(zip(names, hashes.tolist()))) == len(set(names)) == len(set(hashes.tolist()))
    assert len(word_hashes([])[0]) == 0


# --- near duplicates ---


def brute_components(rows, words, num, den):
    sets = {}
    for i, text, *_ in rows:
        w = encode(text).lower().split()
        sets[i] = {tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            both = len(sets[a] & sets[b])
            if a < b and both and den * both >= num * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("words, num", ((3, 85), (5, 80)))
def test_near_duplicates_by_brute_force(spark, words, num):
    rows = passages(120)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(documents(spark, rows), words, num, 100).collect()}
    assert got == brute_components(rows, words, num, 100)


def test_near_duplicate_edges(spark):
    got = neardup.near_duplicates(documents(spark), 3, 85, 100).collect()
    assert len(got) == len(ROWS)
    by = {r.doc_id: r for r in got}
    assert by[2].component_id == 1 and not by[2].kept and by[1].kept
    assert all(by[i].kept and by[i].n_shingles == 0 for i in (3, 4, 5)) and by[10].n_shingles == 1
    assert by[None].kept and by[None].component_id is None
    assert neardup.near_duplicates(empty(spark)).count() == 0


def test_blocks_of_a_large_bucket(spark, monkeypatch):
    """A bucket of more members than a block: pairs between blocks are found as well."""
    monkeypatch.setattr(neardup, "BLOCK", 5)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(40):
        text = list(base)
        text[i % 20] = f"x{i}"
        rows.append((i, " ".join(text), "en"))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(documents(spark, rows), 3, 85, 100).collect()}
    assert got == brute_components(rows, 3, 85, 100)


def family(n, seed=3):
    """Variants of one text of 200 words, with 1 to 9 words changed: some linked with many, some with none."""
    rnd = random.Random(seed)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(n):
        text = list(base)
        for _ in range(rnd.randint(1, 9)):
            text[rnd.randrange(200)] = f"x{rnd.randrange(50)}"
        rows.append((i, " ".join(text), "en"))
    return rows


@pytest.mark.parametrize("words, num, limits", ((3, 85, {}), (5, 80, {}), (3, 85, {"UNIT_SHINGLES": 9_000}), (3, 85, {"FAMILY": 20}), (3, 85, {"BLOCK": 60})))
def test_pairs_of_a_large_family_do_not_grow_with_its_square(spark, monkeypatch, words, num, limits):
    """Few pairs a row become rows; whole, in blocks of full sets, bucket by bucket, and in hot buckets."""
    for k, v in limits.items():
        monkeypatch.setattr(neardup, k, v)
    verified, verify = [], neardup.verify
    monkeypatch.setattr(neardup, "verify", lambda pairs, *args: verified.append(pairs.count()) or verify(pairs, *args))
    rows = family(250)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(documents(spark, rows), words, num, 100).collect()}
    expected = brute_components(rows, words, num, 100)
    assert got == expected and 3 < len({c for _, c in expected.values()}) < 240
    assert sum(verified) < 20 * len(rows)


def test_rows_of_a_hot_bucket_grow_with_its_members(spark):
    """One bucket of 10,000, 20,000 and 40,000 members, of sizes from 5 to 400,000 or all alike: two unit rows a member at most, units of bounded size."""
    from pyspark.sql import functions as F

    for sizes in ("pmod(id * 7919, 400000) + 5", "100 + pmod(id, 10)"):
        for n in (10_000, 20_000, 40_000):
            leaders = spark.range(n).selectExpr("id AS doc_id", f"{sizes} AS n_shingles", "array(-5L, -id - 10) AS bands")
            ordinary, hot = neardup.members_of_buckets(leaders, 85, 100)
            units = neardup.dealt(hot, ["bucket", "klass"])
            assert ordinary.count() == 0 and n <= units.count() <= 2 * n
            assert units.groupBy("unit").count().agg(F.max("count")).first()[0] < 1.3 * neardup.BLOCK
            # every two members of the same or of neighbouring classes meet in some class
            assert hot.where("side = 0").select("doc_id").distinct().count() == n


def test_every_pair_of_a_group_meets_when_blocks_are_paired(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 7)
    rows = spark.range(40).selectExpr("1L AS bucket", "3 AS klass", "0 AS side", "id AS doc_id")
    units = collections.defaultdict(list)
    for r in neardup.paired(rows, ["bucket", "klass"]).collect():
        units[r.unit].append((r.doc_id, r.side, r.crossed))
    met = {tuple(sorted((a[0], b[0]))) for u in units.values() for a in u for b in u if a[0] != b[0] and (a[1] != b[1] or not a[2])}
    assert len(met) == 40 * 39 // 2


def test_super_minhash_estimates():
    rng = np.random.default_rng(3)
    errors = []
    for _ in range(150):
        n, k = int(rng.integers(1, 600)), 0
        k = int(rng.integers(0, n + 1))
        u = rng.integers(0, 1 << 62, 2 * n - k).astype(np.uint64)
        a, b = neardup.super_minhash([u[:n], u[n - k :]])
        errors.append((a == b).mean() - k / (2 * n - k))
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.04
    assert neardup.super_minhash([np.zeros(0, np.uint64)]).shape == (1, neardup.PLACES)
    bands, rows = neardup.banding(85, 100)
    assert (1 - 0.85**rows) ** bands <= 1e-6 and bands * rows <= neardup.PLACES


def test_components(spark):
    links = [(RND.randrange(60), RND.randrange(60)) for _ in range(35)] + [(100 + i, 101 + i) for i in range(30)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    want = {x: find(x) for x in root if any(x in l and l[0] != l[1] for l in links)}
    df = spark.createDataFrame(links, "u bigint, v bigint")
    assert {r.node: r.component for r in components(df.repartition(5)).collect()} == want
    assert components(df.where("false")).count() == 0


# --- packing ---


def test_packing_keeps_every_token(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    rows = [*ROWS, (20, "<|endoftext|> b", ""), (21, "a<|startoftext|>b<|ENDOFTEXT|> x<|endoftext|>", ""), (22, "<|endoftext|>" * 60, "")]
    assert t.encode(rows[-3][1], add_special_tokens=False).ids == [49407, 321]
    got = packing.pack(packing.pieces(documents(spark, rows), tokenizer_path(), capacity=50), capacity=50).toPandas()
    for i, text, _ in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        own = got[got.doc_id.isna()] if i is None else got[got.doc_id == i]
        want = sorted((k, a, len(ids[a : a + 50]), zlib.crc32(np.array(ids[a : a + 50], "<u4").tobytes())) for k, a in enumerate(range(0, len(ids), 50)))
        copies = sum(1 for j, *_ in rows if j == i)
        assert sorted(zip(own.piece, own.start, own.length, own.ids_crc32)) == sorted(want * copies)
    for _, seq in got.groupby("sequence_id"):
        seq = seq.sort_values("offset")
        assert seq.offset.tolist() == [0, *np.cumsum(seq.length)[:-1]] and seq.length.sum() <= 50
    assert packing.pack(packing.pieces(empty(spark), tokenizer_path())).count() == 0


def test_chunk_tokenizer_equals_whole_texts():
    from tokenizers import Tokenizer

    t = packing.ChunkTokenizer(tokenizer_path(), limit=20)
    whole = Tokenizer.from_file(tokenizer_path())
    latin = "".join(map(chr, [*range(33, 127), *range(161, 256)]))
    random_words = ["".join(RND.choice(latin) for _ in range(RND.randint(1, 12))) for _ in range(2_000)]
    texts = [latin, " ".join(random_words), " ".join(random_words).upper(), "x <|endoftext|>y <|startoftext|> <|ENDOFTEXT|>", "don't  STOP\x1cnow\x85x　y É É", "", " \n\t", "a&&&b 12 ½ ß İstanbul Σας", "日本語 テキスト", *(f"word{i} thing" for i in range(60))]
    want = [np.array(whole.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in texts]
    assert list(t(texts)) == want and list(t(texts)) == want


def test_repeated_chunks_are_no_python_objects():
    t = packing.ChunkTokenizer(tokenizer_path())
    texts = [" ".join(f"thing{(i * j) % 97}," for i in range(20_000)) for j in range(1, 11)]
    list(t(texts))
    tracemalloc.start()
    for _ in t(texts):
        pass
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 5_000_000  # 200,000 strings take twice that


def test_sum_of_squares_rule():
    rnd = random.Random(8)
    sizes = [rnd.randint(1, 20) for _ in range(400)]
    bins, offsets = packing.sum_of_squares(np.array(sizes), 20)
    gaps, used = collections.Counter(), {}
    for size, b, at in zip(sizes, bins.tolist(), offsets.tolist()):
        def cost(gap):
            n = gaps.copy()
            if gap < 20:
                n[gap] -= 1
            if gap > size:
                n[gap - size] += 1
            return sum(x * x for g, x in n.items() if 0 < g < 20)

        options = [g for g in range(size, 20) if gaps[g] > 0] + [20]
        gap = 20 - used.get(b, 0)
        assert at == used.get(b, 0) and cost(gap) == min(map(cost, options))
        if gap < 20:
            gaps[gap] -= 1
        used[b] = at + size
        if used[b] < 20:
            gaps[20 - used[b]] += 1
    assert max(used.values()) <= 20


# --- media ---


def unfilter_slowly(raw, h, stride, bpp):
    out = np.zeros((h, stride), np.int64)
    for y in range(h):
        kind = raw[y][0]
        for x in range(stride):
            a = out[y, x - bpp] if x >= bpp else 0
            b = out[y - 1, x] if y else 0
            c = out[y - 1, x - bpp] if y and x >= bpp else 0
            p = a + b - c
            paeth = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c
            out[y, x] = (raw[y][1 + x] + (0, a, b, (a + b) // 2, paeth)[kind]) % 256
    return out.astype(np.uint8)


def test_png_unfilter_by_definition():
    for seed in range(20):
        rng = np.random.default_rng(seed)
        h, w = int(rng.integers(1, 9)), 3 * int(rng.integers(1, 9))
        raw = rng.integers(0, 256, (h, w + 1)).astype(np.uint8)
        raw[:, 0] = rng.integers(0, 5, h)
        assert (media._unfilter(raw, 3) == unfilter_slowly(raw.tolist(), h, w, 3)).all()


def test_png_round_trip_and_damage():
    for payload in (b" " * 192, RND.randbytes(192 * 50), b"hello world " * 16 * 20):
        data = media.png_encode(payload)
        assert media.png_decode(data).tobytes() == payload
        for at in (3, 20, len(data) // 2, len(data) - 6):
            bad = bytearray(data)
            bad[at] ^= 1
            with pytest.raises(ValueError):
                media.png_decode(bytes(bad))
        with pytest.raises(ValueError):
            media.png_decode(data[:-5])


def test_damaged_pictures_are_rows(spark):
    good = media.png_encode(b"x" * 192)
    def made(width, height, body=None, method=0):
        import struct

        chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
        head = struct.pack(">IIBBBBB", width, height, 8, 0, method, 0, 0)
        return media.SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(bytes(1000) if body is None else body)) + chunk(b"IEND", b"")

    bombs = [made(2, 3), made(0, 5), made(1 << 31 - 1, 1 << 30), made(9, 100, method=1), made(9, 100, b""), made(9, 100)[:30], b"", b"\x89PNG\r\n\x1a\n", None]
    df = spark.createDataFrame([(i, 5, x and bytearray(x) if x else x if x is None else bytearray()) for i, x in enumerate([good, made(9, 100), *bombs])], "doc_id bigint, n_bytes bigint, media binary")
    got = {r.doc_id: r for r in media.media_features(df).collect()}
    assert got[0].error is None and got[1].error is None and got[1].payload_bytes == 900
    assert all(got[i].error and got[i].payload_sha256 is None and got[i].feature is None for i in range(2, 2 + len(bombs)))


def test_media_query(spark):
    df = media.media_features(media.encode_media(documents(spark)))
    got = df.collect()
    assert len(got) == len(ROWS) and media.media_features(media.encode_media(empty(spark))).count() == 0
    texts = collections.defaultdict(list)
    for i, text, _ in ROWS:
        texts[i].append(text)
    values = collections.defaultdict(set)
    for r in got:
        raw = encode(texts[r.doc_id][0])
        payload = raw + b" " * (-len(raw) % 192 if raw else 192)
        assert (r.n_bytes, r.payload_bytes) == (len(raw), len(payload)) and r.payload_sha256 == hashlib.sha256(payload).hexdigest()
        assert r.tail_crc32 == zlib.crc32(payload[-16:])
        values[raw].add((r.media_sha256, r.media_bytes, r.feature))
    assert all(len(v) == 1 for v in values.values())


# --- substring removal ---


def test_rank_and_wavelet():
    rng = np.random.default_rng(5)
    bits = rng.integers(0, 2, 300).astype(bool)
    at = np.arange(301)
    assert (Bits(bits).rank(at) == np.concatenate([[0], np.cumsum(bits)])).all()
    text = rng.integers(0, 9, 200)
    w = WaveletMatrix(text, 9)
    for c in range(9):
        assert (w.rank(np.full(201, c), np.arange(201)) == np.concatenate([[0], np.cumsum(text == c)])).all()


def test_matching_blocks_by_definition():
    rng = np.random.default_rng(6)
    for _ in range(60):
        depth = int(rng.integers(1, 9))
        sequences = [rng.integers(1, 4, rng.integers(depth, 20)) for _ in range(rng.integers(1, 10))]
        text = np.concatenate([np.append(s, 0) for s in sequences])
        end = np.cumsum([len(s) + 1 for s in sequences]) - 1
        begin = end - [len(s) for s in sequences]
        index = FMIndex(text, depth)
        at, block = index.matching_blocks(text, begin, end)
        windows = sorted(int(x) for a, b in zip(begin, end) for x in range(a, b - depth + 1))
        assert sorted(at.tolist()) == windows
        for x, k in zip(at.tolist(), block.tolist()):
            alike = [y for y in windows if (text[y : y + depth] == text[x : x + depth]).all()]
            assert index.starts[k + 1] - index.starts[k] == len(alike) and index.least[k] == min(alike)
        assert "suffixes" not in vars(index)


def brute_removal(rows, window):
    first, split = {}, [(i, encode(t).split()) for i, t, *_ in rows]
    for i, w in split:
        for p in range(len(w) - window + 1):
            key = tuple(w[p : p + window])
            first[key] = min(first.get(key, (i, p)), (i, p))
    out = {}
    for i, w in split:
        gone = {q for p in range(len(w) - window + 1) if first[tuple(w[p : p + window])] < (i, p) for q in range(p, p + window)}
        out[i] = (len(w), len(gone), hashlib.sha256(b" ".join(x for q, x in enumerate(w) if q not in gone)).hexdigest())
    return out


@pytest.mark.parametrize("window, group_bytes, index_words, hot", ((5, 10**7, 10**6, 10**6), (5, 500, 50, 10**6), (20, 2000, 200, 10**6), (5, 10**7, 10**6, 1), (5, 500, 50, 8), (20, 2000, 200, 5)))
def test_removal_by_brute_force(spark, window, group_bytes, index_words, hot):
    rows = passages(80, seed=window) + [(1000, "a a a a a a a a a a a a " * 5, "x"), (1001, None, "x"), (1002, "", "x")]
    out = substring.remove_repeats(documents(spark, rows), window, min(4, window), group_bytes, index_words, hot).collect()
    want = brute_removal(rows, window)
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in out} == want
    assert all(hashlib.sha256(encode(r.kept_text)).hexdigest() == r.kept_sha256 for r in out)


def test_removal_edges(spark):
    out = substring.remove_repeats(documents(spark), 5).collect()
    assert len(out) == len(ROWS)
    by = {(r.doc_id, r.n_words): r.n_removed for r in out}
    assert by[1, 13] == 0 and by[2, 13] == 13 and by[3, 0] == by[4, 0] == 0
    assert substring.remove_repeats(empty(spark)).count() == 0


# --- language model ---


def bare_model(rows):
    """A model over the counts of ``rows`` made without Spark, with zero weights."""
    token, starts = lm.tokens([t for _, t, _ in rows])
    known, n = np.unique(token, return_counts=True)
    symbols = lm.Symbols(token=known, count=n, own=np.arange(len(known), dtype=np.int32))
    symbols.index()
    tree = lm.grow_tree(n - lm.DISCOUNT, lm.DISCOUNT * len(n))
    weights = [np.zeros((tree.rows[k > 0], lm.BRANCHES), np.float32) for k in range(lm.FEATURES)]
    weights[0] += tree.share[tree.shares_by_row(0)]
    return lm.Model(symbols, tree, weights, np.round(lm.UNIT * lm.DISCOUNT / n).astype(np.uint32)), token, starts


def test_base_scores_and_probabilities(spark):
    rows = [(i, t, l) for i, t, l in passages(40)] + [(900, None, "en"), (901, "", "en"), (902, "never seen before", "en")]
    train = documents(spark, [r for r in rows if r[0] < 30])
    c = collections.Counter()
    for i, t, _ in rows:
        if i < 30:
            c.update([*encode(t).lower().split(), None])
    n, v = sum(c.values()), len(c)
    scores = []
    for head in (lm.HEAD_LIMIT, 20, 0):  # all tokens symbols of their own, some, none
        fitted = lm.fit(train, head_limit=head, tail_limit=4096 + 64)
        assert (fitted.n, fitted.v, fitted.tail is None) == (n, v, head == lm.HEAD_LIMIT)
        got = {r.doc_id: r for r in lm.score(documents(spark, rows), fitted).collect()}
        for i, t, _ in rows:
            own = [*encode(t).lower().split(), None]
            assert got[i].n_tokens == len(own) and got[i].n_known == sum(c[w] > 0 for w in own) and got[i].train_tokens == n
            assert math.isclose(got[i].base_score, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own), rel_tol=1e-9)
            assert got[i].score < 0
        scores.append(sum(r.score for r in got.values()))
    assert scores[0] > scores[2]


@pytest.mark.parametrize("head", (lm.HEAD_LIMIT, 15))
def test_events_sum_to_one(spark, head):
    """For any history, all known tokens and the unknown share one, also where tokens share a symbol."""
    rows = passages(60)
    fitted = lm.fit(documents(spark, rows), head_limit=head, tail_limit=4096 + 64)
    m = lm.Parcel(fitted.model, True).open()
    token, starts = lm.tokens(["w1 w2 w3 x"])
    hashed = lm.features(token, starts)[:, 3:4]
    paths = np.exp(lm.log_probs(m, np.repeat(hashed, len(m.tree.code), axis=1), m.tree.code)[0])
    total = np.exp(lm.log_probs(m, hashed, np.array([lm.BRANCHES - 1]))[0][0])
    assert total > 0
    counts = collections.Counter()
    for _, t, _ in rows:
        counts.update([*t.split(), None])
    s = m.symbols
    assert (len(s.token) < len(counts)) == (head == 15)
    for w, n in counts.items():
        t = np.array([lm.END]) if w is None else lm.tokens([w])[0][:1]
        at = s.find(t)
        total += paths[s.symbol(t, at)[0]] * (1 if at[0] >= 0 else n / s.size[s.bucket(t)[0]])
    assert abs(total - 1) < 1e-6


def test_gradient_by_definition():
    """O and E of every weight against a loop over places and steps of the path."""
    rows = passages(12)
    model, token, starts = bare_model(rows)
    rnd = np.random.default_rng(3)
    for k in range(lm.FEATURES):
        model.weights[k] += rnd.normal(size=model.weights[k].shape).astype(np.float32) * 0.3
    taken, hoped = lm.gradient_sums(model, iter([(token, starts)]), True)
    want_o = [np.zeros(len(x)) for x in taken]
    want_e = [np.zeros(len(x)) for x in taken]
    hashed, tree = lm.features(token, starts), model.tree
    for i, t in enumerate(token):
        s = int(np.searchsorted(model.symbols.token, t))
        code, node, gone, first = int(tree.code[s]), 0, int(model.gone[s]), True
        while node >= 0:
            branch = code % lm.BRANCHES
            at = [int(tree.base[int(k > 0), node] + (int(hashed[k, i]) * int(tree.size[int(k > 0), node]) >> 32)) for k in range(lm.FEATURES)]
            z = sum(model.weights[k][at[k]].astype(float) for k in range(lm.FEATURES))
            p = np.exp(z) / np.exp(z).sum()
            for k in range(lm.FEATURES):
                cell = at[k] * lm.BRANCHES
                want_o[k][cell + branch] += lm.UNIT - gone
                want_o[k][cell + lm.BRANCHES - 1] += gone if first else 0
                want_e[k][cell : cell + lm.BRANCHES] += p * (1 if first else 1 - gone / lm.UNIT)
            node, code, first = int(tree.child[node * lm.BRANCHES + branch]), code // lm.BRANCHES, False
    for k in range(lm.FEATURES):
        assert np.array_equal(taken[k], want_o[k]) and np.allclose(hoped[k], want_e[k], atol=1e-4)
        assert np.isclose(taken[k].sum() / lm.UNIT, hoped[k].sum(), rtol=1e-5)


def test_first_round_expects_the_shares():
    """At zero weights the expected counts are those of the closed form that the first round uses."""
    model, token, starts = bare_model(passages(30))
    taken, hoped = lm.gradient_sums(model, iter([(token, starts)]), True)
    for k in range(lm.FEATURES):
        node = model.tree.shares_by_row(int(k > 0))
        o = taken[k].reshape(-1, lm.BRANCHES) / lm.UNIT
        e = o.sum(1, keepdims=True) * np.exp(model.tree.share[node].astype(float))
        skip = int(k > 0)  # the row of nodes without rows
        assert np.allclose(e[skip:], hoped[k].reshape(-1, lm.BRANCHES)[skip:], atol=1e-3)


def test_scores_do_not_depend_on_the_split(spark):
    rows = passages(80)
    docs = documents(spark, rows)
    one, eight = ({r.doc_id: r.score for r in lm.score(docs, lm.fit(docs.repartition(n), rounds=2)).collect()} for n in (1, 8))
    assert all(math.isclose(one[i], eight[i], rel_tol=1e-6) for i in one)


def test_training_visits_every_place(spark):
    """However texts are batched, each place of each text, its end too, counts once in each feature's sums."""
    rows = passages(30)
    model, token, starts = bare_model(rows)
    parts = [lm.tokens([t for _, t, _ in rows[a : a + 7]]) for a in range(0, 30, 7)]
    whole, split = lm.gradient_sums(model, iter([(token, starts)]), False)[0], lm.gradient_sums(model, iter(parts), False)[0]
    assert all(np.array_equal(a, b) for a, b in zip(whole, split))
    root = model.tree.size[0, 0] * lm.BRANCHES
    assert whole[0][:root].sum() == lm.UNIT * sum(len(t.split()) + 1 for _, t, _ in rows)
    with pytest.raises(ValueError):
        lm.fit(documents(spark, rows), rounds=0)


def test_rare_tokens_depend_on_their_history(spark):
    rows = [(i, " ".join(w for j in range(40) for w in (f"left{(i + j) % 60}", f"right{(i + j) % 60}")), "en") for i in range(60)]
    docs = documents(spark, rows)
    pair = documents(spark, [(1, "left7 right7", ""), (2, "left8 right7", "")])
    for rounds in (1, 2):
        got = {r.doc_id: r.score for r in lm.score(pair, lm.fit(docs, rounds=rounds)).collect()}
        assert (got[1] - got[2]) * math.log(10) > 0.5  # natural log, as asked before of the branch alone


def test_model_beats_base_on_held_out_texts(spark):
    out = registry.queries()["op9_lm_scoring"](spark, SF.replace("0.001", "0.01")).toPandas()
    held = out[out.held_out]
    assert held.score.sum() / held.n_tokens.sum() > -3.15 and held.base_score.sum() / held.n_tokens.sum() < -4.1
    fitted = lm.fit(empty(spark))
    assert fitted.n == fitted.v == 0
    assert all(r.n_known == 0 for r in lm.score(documents(spark), fitted).collect())
    assert lm.score(empty(spark), fitted).count() == 0


# --- pipeline ---


def test_batches_come_from_spark_as_small_as_they_are_handed_on(spark):
    def make():
        return lambda batch: pa.RecordBatch.from_arrays([pa.array([batch.get_total_buffer_size()] * batch.num_rows)], ["size"])

    rows = spark.range(0, 5_000, 1, 1).selectExpr("repeat('x', 1000) text")
    got = [r["size"] for r in over_batches(rows, make, "size long").collect()]
    assert len(got) == 5_000 and max(got) < 2_500_000  # 1,000 rows; all rows are 5 MB


def test_search_for_items_holds_few_characters_at_once():
    rnd = random.Random(5)
    texts = ["".join(rnd.choices("abcdefgh ", k=3_000)) for _ in range(1_000)]
    index = decontam.ItemIndex([(1, texts[700][1_000:1_300])])
    tracemalloc.start()
    found = list(decontam.search(index, texts))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [x[:2] for x in found] == [(700, 1)] and peak < 25_000_000  # 34 MB with slices of 1.5 million characters


def test_pipeline_stages(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "minhash_neardup", "decontamination", "packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, ids = docs.columns, {r.doc_id for r in docs.collect()}
    frames = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialise(stage(spark, docs, SF), name)
        assert docs.columns == columns
        frames[name] = docs.toPandas()
        kept = set(frames[name].doc_id)
        assert kept <= ids
        ids = kept
    assert len(frames["language_id"]) > 150
    rows = [(r.doc_id, r.text) for r in frames["line_dedup"].itertuples()]
    groups = brute_components(rows, 5, 80, 100)
    assert set(frames["minhash_neardup"].doc_id) == {i for i, (_, c) in groups.items() if c == i}
    items = [" ".join(x.lower().split()) for x in pd.read_parquet(f"{SF}/benchmark.parquet").text]
    left = [" ".join((t or "").lower().split()) for t in frames["decontamination"].text]
    assert not any(x in t for t in left for x in items)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).toPandas()
    assert set(packed.doc_id) == ids and packed.groupby("sequence_id").length.sum().max() <= 4096
