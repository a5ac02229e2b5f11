import collections

import numpy as np
import pyarrow as pa
import pytest

from longspan.functions.tags import rolling_tags
from longspan.operators import places, report, suffixes
from longspan.plans import catalogue
from tests.helpers import SF

BYTE_QUERIES = [q for q in catalogue.QUERIES if q.endswith("_documents")]


@pytest.mark.parametrize("name", BYTE_QUERIES)
def test_bytes_of_documents_are_no_rows_of_a_shuffle(spark, name):
    """A byte is no row before it is summed, so a table's bytes are neither sorted nor shuffled."""
    plan = catalogue.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Generate" not in plan and "Expand" not in plan


def test_pieces_give_what_the_whole_text_gives(spark, monkeypatch):
    rng = np.random.default_rng(3)
    texts = {1: rng.integers(97, 101, 1000).astype(np.uint8).tobytes(), 2: b"x" * 31, 3: b"y" * 30, 4: b"", 5: b"z" * 257, 6: None}
    monkeypatch.setattr(places, "PIECE", 64)
    for data in filter(None, texts.values()):
        tags = rolling_tags(data)
        got = list(places.tag_pieces(memoryview(data)))
        assert len(got) == -(-len(tags) // 64)
        if len(tags):
            assert np.array_equal(np.concatenate([v for _, v in got]), tags) and np.array_equal(np.concatenate([p for p, _ in got]), np.arange(len(tags)))
        raw = np.frombuffer(data, np.uint8)
        coded = b"".join(places.delta_pieces(memoryview(data)))
        assert np.array_equal(np.frombuffer(coded, np.uint8), raw - np.concatenate([np.zeros(min(4, len(raw)), np.uint8), raw[:-4]]))
        assert b"".join(places.undelta_pieces(places.delta_pieces(memoryview(data)))) == data
        counts, want = np.zeros(4096, np.int64), collections.Counter()
        places.gap_counts(memoryview(data), counts)
        for b in set(data):
            want.update(np.diff(np.flatnonzero(raw == b)).tolist())
        assert {int(g): int(counts[g]) for g in np.flatnonzero(counts)} == want
    df = spark.createDataFrame([(k, None if x is None else bytearray(x)) for k, x in texts.items()], "id bigint, data binary")
    assert {r.id: (r.total, r.first_places) for r in places.tag_sets(df, "id").collect()} == {
        k: (len(set(t.tolist())), len({int(x) & 255 for x in t})) for k, t in ((k, rolling_tags(x or b"")) for k, x in texts.items()) if len(t)
    }
    assert {(r.id, r.n_bytes, r.same) for r in places.delta_returns(df, "id").collect()} == {(k, len(x), True) for k, x in texts.items() if x}


def test_encrypted_archives_are_made_and_opened_once(spark):
    plan = catalogue.QUERIES["encrypted_roundtrip"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 2 and "Join" not in plan


@pytest.mark.parametrize("name", ("validate_archive", "stage_percentages"))
def test_archives_are_made_once_for_their_report(spark, name):
    plan = catalogue.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 2 and "Join" not in plan


def test_reports_of_damaged_and_empty_archives(spark):
    rows = [("a", 0, 0, 0, 3, 10, 10, 50, 40, None), ("a", 0, 0, 1, 4, 9, 20, 50, 30, None), ("a", 0, 1, 0, 3, 0, 0, 50, 0, None), ("a", 1, 0, 0, 5, 4, 6, 7, 0, None),
            ("b", None, None, None, None, None, None, None, None, "cut"), ("c", 0, 0, 0, 3, 0, 0, 0, 0, None)]
    index = spark.createDataFrame(rows, "archive_id string, chunk_no int, stream_no int, block_no int, c_type int, c_len bigint, u_len bigint, chunk_size bigint, next_head bigint, error string")
    assert {tuple(r) for r in report.validated(index).collect()} == {("a", 0, 1), ("b", 1, 0), ("c", 0, 0)}
    got = {r.archive_id: (r.n_chunks, r.n_blocks, r.original, r.u_total, r.c_total, r.first_type) for r in report.archive_summary(index).collect()}
    assert got == {"a": (2, 3, 57, 36, 23, 3), "c": (1, 0, 0, 0, 0, None)}


def test_blocks_are_coded_some_at_a_time(spark, monkeypatch):
    """Memory of a worker: no batch that leaves a task has more than ``BYTES`` or so, however large the table's part."""
    seen = []
    rows = [(str(i), 0, bytearray(b"ab" * 2048)) for i in range(3000)]
    df = spark.createDataFrame(rows, "archive_id string, chunk_no int, data binary").coalesce(1)
    sizes = suffixes.bwt_rows(df).mapInArrow(lambda bs: (pa.RecordBatch.from_arrays([pa.array([b.nbytes], pa.int64())], ["n"]) for b in bs), "n bigint").collect()
    seen = [r.n for r in sizes]
    assert len(seen) >= 3 and max(seen) < 6_000_000
