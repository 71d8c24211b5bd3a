"""Stateful streams over several batches against plain loops over the same rows."""

import datetime as dt
import random

import pytest

from panelforge.streaming import panels as P
from panelforge.streaming import states as S

T0 = dt.datetime(2024, 1, 1)


def run(spark, tmp_path, batches, shape, plan):
    """The rows that plan's stream gives when the batches come one after another."""
    folder, out = tmp_path / "in", []
    spark.createDataFrame([], shape).write.parquet(str(folder / "none"))
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, shape).coalesce(1).write.parquet(str(folder / f"b{n}"))
        stream = plan(spark.readStream.schema(shape).option("recursiveFileLookup", "true").parquet(str(folder)))
        q = stream.writeStream.outputMode("append").foreachBatch(lambda b, i: out.extend(map(tuple, b.collect()))).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination()
    return out


@pytest.fixture(scope="module")
def rows():
    dice = random.Random(5)
    made = [(dice.choice("abc"), T0 + dt.timedelta(minutes=i), dice.choice([10.0, 10.0, 14.0, 6.0, None])) for i in range(240)]
    return made, [made[:90], made[90:91], made[91:]]


def loops(rows, two, rest=0):
    out = []
    for key in "abc":
        up = down = 0.0
        last, seen = None, 0
        for k, ts, v in rows:
            if k != key or v is None:
                continue
            up, down = max(0.0, up + v - 10 - 0.5), max(0.0, down - v + 10 - 0.5)
            if two and max(up, down) > 5 and (last is None or seen - last >= rest):
                out.append((key, ts, "up" if up >= down else "down", max(up, down)))
                up, down, last = 0.0, 0.0, seen
            elif not two and up > 5:
                out.append((key, ts, up))
                up = 0.0
            seen += 1
    return sorted(out)


@pytest.mark.parametrize("rest", [1, 7])
def test_two_sided(spark, tmp_path, rows, rest):
    made, batches = rows
    got = run(spark, tmp_path, batches, "k string, ts timestamp, v double", lambda s: S.two_sided(s, "k", "ts", "v", 10.0, 0.5, 5.0, rest))
    want = loops(made, True, rest)
    assert sorted(got) == want and {w[2] for w in want} == {"up", "down"}


def test_one_sided(spark, tmp_path, rows):
    made, batches = rows
    kept = [[r for r in b if r[2] is not None] for b in batches]
    assert sorted(run(spark, tmp_path, kept, "k string, ts timestamp, v double", lambda s: P.detector(s, "k", "ts", "v", 10.0, 0.5, 5.0))) == loops(made, False)


def test_repeats_are_flagged_and_kept(spark, tmp_path):
    dice = random.Random(6)
    made = [(dice.choice("abcd"), T0 + dt.timedelta(hours=i), i) for i in range(60)]
    got = run(spark, tmp_path, [made[:20], made[20:40], made[40:]], "k string, ts timestamp, id long", lambda s: S.flagged(s, "k", "ts", "id", "30 days"))
    want = [(k, ts, i, (n := sum(x[0] == k for x in made[: j + 1])), n > 1) for j, (k, ts, i) in enumerate(made)]
    assert sorted(got) == sorted(want)


def test_idents_are_forgotten(spark, tmp_path):
    batches = [[("a", T0, 1)], [("b", T0 + dt.timedelta(days=9), 2)], [("b", T0 + dt.timedelta(days=10), 3)], [("a", T0 + dt.timedelta(days=11), 4), ("b", T0 + dt.timedelta(days=11), 5)]]
    got = {r[2]: r[3] for r in run(spark, tmp_path, batches, "k string, ts timestamp, id long", lambda s: S.flagged(s, "k", "ts", "id", "1 day"))}
    assert got[1] == 1 and got[4] == 1 and got[5] == 3


def test_late_rows_are_set_aside(spark):
    seen, late, newest = [], [], [None]
    sink = S.divided("ts", "1 day", lambda: newest[0], lambda b, n: seen.extend(r["id"] for r in b.collect()), lambda b, n: late.extend(r["id"] for r in b.collect()))
    at = lambda d: T0 + dt.timedelta(days=d)
    for n, (rows, new) in enumerate([([(1, at(5)), (2, at(0)), (9, None)], at(5)), ([(3, at(3)), (4, at(4)), (5, at(9))], at(9)), ([(6, at(7.9)), (7, at(8))], at(9))]):
        sink(spark.createDataFrame(rows, "id long, ts timestamp"), n)
        newest[0] = new
    assert sorted(seen) == [1, 2, 4, 5, 7] and sorted(late) == [3, 6, 9]
