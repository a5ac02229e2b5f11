import collections

import numpy as np
import pytest

from longspan.functions.tags import rolling_tags
from longspan.plans import catalogue
from tests.helpers import SF, same

ORACLES, QUERIES = catalogue.oracle_sql(), catalogue.queries()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, name):
    same(QUERIES[name](spark, SF), ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_gives_rows(spark, name):
    df = QUERIES[name](spark, SF)
    assert df.columns and df.count() > 0


def test_entry(spark):
    import __spark_entry__

    assert set(QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_byte_queries_of_documents(spark):
    """All bytes of all documents, by brute force; some texts are of several pieces."""
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    assert max(map(len, texts.values())) > 3 * 4096

    def ordered(name, column):
        t = QUERIES[f"{name}_documents"](spark, SF).toArrow()
        ids, pos, value = (t.column(c).to_numpy() for c in ("doc_id", "pos", column))
        order = np.lexsort((pos, ids))
        return ids[order], pos[order], value[order]

    def equal(name, column, values, kept=lambda v: np.ones(len(v), bool)):
        want = [(i, np.flatnonzero(kept(v)), v[kept(v)]) for i, v in ((i, values(texts[i])) for i in sorted(texts))]
        ids, pos, value = ordered(name, column)
        assert np.array_equal(ids, np.repeat([i for i, _, _ in want], [len(p) for _, p, _ in want]))
        assert np.array_equal(pos, np.concatenate([p for _, p, _ in want])) and np.array_equal(value, np.concatenate([v for _, _, v in want]))

    raw = lambda x: np.frombuffer(x, np.uint8).astype(int)
    low = lambda v, bits: (v & (1 << bits) - 1) == (1 << bits) - 1
    equal("rolling_tag", "tag", rolling_tags)
    equal("sampled_anchors", "tag", rolling_tags, lambda v: low(v, 4))
    equal("delta_encode", "coded", lambda x: (raw(x) - np.concatenate([np.zeros(min(4, len(x)), int), raw(x)[:-4]])) % 256)
    equal("delta_decode", "decoded", raw)
    same = {(r.doc_id, r.n_bytes, r.same) for r in QUERIES["delta_roundtrip_documents"](spark, SF).collect()}
    assert same == {(i, len(x), True) for i, x in texts.items() if x}
    density = {(r.doc_id, r.bits, r.places, r.anchors) for r in QUERIES["anchor_density_documents"](spark, SF).collect()}
    tags = {i: rolling_tags(x) for i, x in texts.items()}
    assert density == {(i, n, len(v), int(low(v, n).sum())) for i, v in tags.items() if len(v) for n in (1, 2, 4, 6)}
    gaps = collections.Counter()
    for x in texts.values():
        for byte in set(x):
            gaps.update(np.diff(np.flatnonzero(raw(x) == byte)).tolist())
    assert max(gaps) >= 4096
    want = {g: n for g, n in gaps.items() if g < 4096}
    assert {r.gap: r.n for r in QUERIES["byte_gap_histogram_documents"](spark, SF).collect()} == want
    best = sorted(want.items(), key=lambda g: (-g[1], g[0]))[:2]
    assert [(r.gap, r.n) for r in QUERIES["top_periods_documents"](spark, SF).collect()] == best


def test_codec_sizes_of_all_levels(spark):
    got = [(r.method, r.level) for r in QUERIES["codec_sizes"](spark, SF).collect()]
    assert sorted(got) == sorted((m, level) for m in catalogue.SUPPORTED[1:] for level in range(1, 10))
