import os
import random

from longspan.operators import matches, stretches
from longspan.sources.shared import shared_dir
from tests.test_operators import brute_coverage


def some_texts(n: int) -> list[tuple[int, str]]:
    rnd = random.Random(7)
    words = ["aaaa", "ab", "é", "漢字", "the ", "tion", "\U0001f600", "x" * 40, "and in the ", "0123456789abcdefghijklmnopqrstuv"]
    pieces = ["".join(rnd.choice(words) for _ in range(rnd.randint(3, 12))) for _ in range(12)]
    rows = [(i, "".join(rnd.choice(pieces) + rnd.choice(words) for _ in range(rnd.randint(0, 6)))) for i in range(n)]
    return [*rows, (n, rows[3][1]), (n + 1, rows[3][1]), (n + 2, "z" * 300), (n + 3, "z" * 290)]


def brute_runs(rows, width=31):
    seen, pairs = {}, {}
    for key, text in sorted(rows):
        for i in range(len(text) - width + 1):
            if (g := text[i : i + width]) in seen:
                pairs[key, i] = seen[g]
            seen[g] = key, i
    out = []
    for (key, i), (source, j) in sorted(pairs.items()):
        if pairs.get((key, i - 1)) != (source, j - 1):
            n = 0
            while pairs.get((key, i + n)) == (source, j + n):
                n += 1
            out.append((key, i + 1, source, j + 1, n + width - 1))
    return out


def test_coverage_and_runs_over_many_batches(spark, monkeypatch):
    monkeypatch.setattr(stretches, "BATCH_BYTES", 1500)
    rows = some_texts(40)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    assert {r.doc_id: r.covered_chars for r in matches.coverage(df).collect()} == brute_coverage(rows)
    assert sorted(map(tuple, matches.match_runs(df).collect())) == brute_runs(rows)


def test_places_are_moved_as_arrays_and_nothing_is_written(spark):
    """Disk: no table of anchors, stretches or grams is written, and no row stands for a place."""
    rows = spark.createDataFrame([(i, "the same long passage of more than a few characters, again and again " * 3 + str(i)) for i in range(50)], "doc_id bigint, text string")
    folder = shared_dir(spark).removeprefix("file://")
    was = set(os.listdir(folder))
    for found in (matches.coverage(rows), matches.match_runs(rows)):
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "Window" not in plan and "Generate" not in plan
        assert found.count() >= 49
    assert set(os.listdir(folder)) == was
