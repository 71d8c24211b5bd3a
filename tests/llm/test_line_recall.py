"""Of passages that two documents share, how much goes; what must stay."""

import pytest

from panelforge.llm import line_dedup


@pytest.mark.parametrize("n, least", [(3, 0.9), (4, 0.92), (6, 0.95), (10, 0.95)])
def test_shared_passages(spark, n, least):
    """400 passages of n lines, each in two documents between five lines of their own."""
    rows = []
    for p in range(400):
        passage = [f"line {k} of passage {p}" for k in range(n)]
        for copy in range(2):
            own = [f"line {k} of document {p} {copy}" for k in range(10)]
            rows.append((2 * p + copy, "\n".join(own[:5] + passage + own[5:])))
    got = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sum(r["n_removed"] for r in got if r["doc_id"] % 2 == 0) == 0
    assert all("of document" not in x for r in got for x in set(dict(rows)[r["doc_id"]].split("\n")) - set(r["kept"].split("\n")))
    assert sum(r["n_removed"] > 0 for r in got if r["doc_id"] % 2) >= least * 400 and sum(r["n_removed"] for r in got) >= least * 400 * n


def test_lines_that_repeat_alone_stay(spark):
    rows = [(i, f"start {i}\nsame line\nend {i}") for i in range(50)] + [(100, "a\n\n\nb"), (101, "c\n\n\nd"), (102, "\n".join(["again and again"] * 6)), (103, "x\n" * 3000)]
    got = {r["doc_id"]: r for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i]["n_removed"] == 0 for i in [*range(50), 100, 101])
    assert got[102]["n_removed"] > 0 and got[102]["kept"] != "" and got[103]["n_lines"] == 3001
