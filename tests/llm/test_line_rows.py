"""Line dedup over rows with null and repeated ids, whether few rows change or many."""

import pytest

from panelforge.llm import line_dedup, storage

PASSAGE = "\n".join(f"line {i} of a passage" for i in range(40))


@pytest.mark.parametrize("most", [2_000_000, 0])
def test_rows_of_any_id(spark, monkeypatch, most):
    monkeypatch.setattr(storage, "BROADCAST_ROWS", most)
    rows = [(None, PASSAGE), (5, "top\n" + PASSAGE), (3, PASSAGE), (3, PASSAGE), (9, None), (None, ""), (7, "one\ntwo"), (8, "")]
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, digest string, chunk string").repartition(3)
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_lines"], r["n_removed"], r["kept"].count("passage")) for r in line_dedup.line_dedup(docs).collect())
    whole = [x for x in got if x[2] == 40 and x[3] == 0]
    assert len(got) == 8 and whole == [(False, 3, 40, 0, 40)]  # of rows with an id the smallest, one row of it
    assert all(x[3] + x[4] == 40 for x in got if x[2] >= 40)
    assert [x[2:] for x in got if x[1] in (7, 8, 9)] == [(2, 0, 0), (1, 0, 0), (0, 0, 0)]
