"""Rows that share an id are documents of their own: op6, op10 and the stages, against brute force; columns of any name."""

import pytest
from pyspark.sql import functions as F

from panelforge.llm import decontaminate, exact_dedup, minhash, quality, substring, suffix

W = " ".join(f"w{i}" for i in range(80))
A, C = "a" * 30 + " ".join(f"x{i}" for i in range(120)), "lead " + " ".join(f"y{i}" for i in range(90))
TABLES = {
    "copies": [(1, C + A), (2, A), (2, "short text"), (3, "other words here"), (None, A), (4, A)],
    "windows": [(1, "p q r " + W), (2, W), (2, "only four words here"), (3, " ".join(f"u{i}" for i in range(300))), (3, None), (3, "")],
    "same twice": [(5, W), (5, W), (5, W + " tail"), (6, "a b c")],
}


def words_kept(rows, span=35):
    docs = [(t or "").split() for _, t in rows]
    seen = {}
    for d, w in enumerate(docs):
        if rows[d][0] is not None:
            for i in range(len(w) - span + 1):
                seen.setdefault(tuple(w[i : i + span]), []).append((d, i))
    out = []
    for d, w in enumerate(docs):
        gone = set()
        for i in range(len(w) - span + 1):
            if len(seen.get(tuple(w[i : i + span]), [])) > 1 and rows[d][0] is not None:
                gone |= set(range(i, i + span))
        out.append((rows[d][0], len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone).encode()))
    return out


def bytes_kept(rows, span=100):
    """Rows of equal ids in order of their place; here that is the order of the list."""
    order = sorted((r for r in range(len(rows)) if rows[r][0] is not None), key=lambda r: (rows[r][0], r))
    seen, out = set(), []
    for r in [*order, *(r for r in range(len(rows)) if rows[r][0] is None)]:
        b, gone = (rows[r][1] or "").encode(), set()
        for i in range(len(b) - span + 1):
            s = b[i : i + span]
            if rows[r][0] is not None:
                if s in seen:
                    gone |= set(range(i, i + span))
                seen.add(s)
        runs = sum(1 for i in gone if i - 1 not in gone)
        out.append((rows[r][0], len(b), len(gone), runs, bytes(x for i, x in enumerate(b) if i not in gone)))
    return out


@pytest.mark.parametrize("name", sorted(TABLES))
def test_repeated_ids_keep_their_own_texts(spark, name):
    rows = TABLES[name]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    got = [(*r[:-1], bytes(r[-1])) for r in map(tuple, substring.word_dedup(docs).collect())]
    assert sorted(got, key=key) == sorted(words_kept(rows), key=key)
    got = [(*r[:-1], bytes(r[-1])) for r in map(tuple, suffix.byte_dedup(docs).collect())]
    assert sorted(got, key=key) == sorted(bytes_kept(rows), key=key)


def test_columns_of_any_name(spark, tmp_path):
    odd = ["_file", "_at", "_nth", "_row_number", "_spans", "_items", "_n_words", "_grade", "_tail", "_selected", "node", "root", "c0", "c1"]
    rows = [(1, "Same text"), (2, "same text"), (3, W), (4, W + " end"), (5, "alpha beta gamma")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", "text", *[F.concat(F.lit(c), F.col("doc_id").cast("string")).alias(c) for c in odd])
    docs.write.parquet(str(tmp_path / "docs"))
    item = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    model = quality.train(docs, spark.createDataFrame([], "doc_id long, grade int"))
    for given in (docs, spark.read.parquet(str(tmp_path / "docs"))):
        for left, ids in (
            (exact_dedup.distinct_texts(given), [2, 3, 4, 5]),
            (minhash.distinct_groups(given), [1, 3, 5]),
            (decontaminate.without_hits(given, item), [1, 2, 3, 4]),
            (quality.selected(given, model), [1, 2, 3, 4, 5]),
        ):
            assert left.columns == given.columns
            got = sorted(map(tuple, left.collect()))
            assert [r[0] for r in got] == ids and all(r[2:] == tuple(c + str(r[0]) for c in odd) for r in got)
