"""Decontamination judges rows, not ids, and gives the same rows whether the benchmark is broadcast or joined."""

import pyarrow as pa
import pytest

from panelforge.llm import decontaminate

ITEMS = [(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"), (2, "one two three"), (2, "four five"), (3, "beta gamma delta epsilon zeta eta theta iota kappa lambda"), (None, "clean text"), (4, None)]
ROWS = [
    (None, "x one two three y", 1),
    (None, "a clean text", 2),
    (7, "four five", 3),
    (7, "nothing here", 4),
    (7, "four five", 5),
    (8, None, 6),
    (9, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu", 7),
]


@pytest.mark.parametrize("block", [16_000_000, 10])
def test_null_and_repeated_ids(spark, block):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, _row long").repartition(3)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = [(r["doc_id"], r["n_words"], [(s["start"], s["end"]) for s in r["spans"]], r["items"]) for r in decontaminate.benchmark_hits(docs, items, block_bytes=block).collect()]
    want = [(None, 5, [(1, 4)], ["2"]), (None, 3, [], []), (7, 2, [(0, 2)], ["2"]), (7, 2, [], []), (7, 2, [(0, 2)], ["2"]), (8, 0, [], []), (9, 13, [(0, 12)], ["1", "3"])]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    clash = docs.withColumnRenamed("_row", "_spans")
    left = decontaminate.without_hits(docs, items, block_bytes=block)
    assert sorted(r["_row"] for r in left.collect()) == [2, 4, 6] and left.columns == docs.columns
    assert decontaminate.benchmark_hits(clash, items, block_bytes=block).count() == 7


def test_equal_hashes_with_other_words_are_told_apart(monkeypatch):
    import numpy as np

    from panelforge.llm import kernels

    monkeypatch.setattr(kernels, "grams", lambda h, k, mult=None: np.zeros(max(0, len(h) - k + 1), np.uint64))
    index = decontaminate.Windows([("a", "x y"), ("b", "z w"), ("c", "x y")], 2)
    n, spans, found = index.scan(pa.array(["z w", "q x y", "w z"]))
    assert n.tolist() == [2, 3, 2] and spans == [[(0, 2)], [(1, 3)], []] and found == [{"b"}, {"a", "c"}, set()]
