"""The conversation trie against a plain reading of its definition."""

import hashlib
import random
import re
import zlib

import pytest

from panelforge.llm import trie

SHAPE = "conv_id long, turn long, role string, text string"


def plain(rows):
    turns = {}
    for c, t, role, text in rows:
        if c is not None:
            turns.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    key = lambda x: (x[0], x[1], hashlib.sha256(f"{len(x[2].encode())}:{x[2]}{x[3]}".encode()).digest())
    own = {c: [x[2:] for x in sorted(v, key=key)] for c, v in turns.items()}
    whole = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        whole[c] = own.get(base, [])[:h] + own[c][h:]
    members = {}
    for c, seq in whole.items():
        for d in range(len(seq) + 1):
            members.setdefault(tuple(seq[:d]), []).append(c)
    out = {}
    for seq, ids in members.items():
        below = [s for s in members if s[: len(seq)] == seq]
        ended = sorted(c for c in ids if len(whole[c]) == len(seq))
        words = lambda s: len(re.findall("[^\x20\x09-\x0d]+", s[-1][1])) if s else 0
        out[min(ids), len(seq)] = (
            min(members[seq[:-1]]) if seq else None,
            len(ids),
            sum(len(s) == len(seq) + 1 for s in below),
            sum(not any(len(t) == len(s) + 1 and t[: len(s)] == s for t in below) for s in below),
            sum((len(members[s]) - 1) * words(s) for s in below),
            hashlib.sha256(",".join(map(str, ended)).encode()).hexdigest(),
        )
    return out


def check(spark, rows):
    got = trie.prefix_trie(spark.createDataFrame(rows, SHAPE)).collect()
    assert {(r["conv_id"], r["depth"]): tuple(r)[2:] for r in got} == plain(rows) and len(got) == len(plain(rows))


def test_random_conversations(spark):
    dice = random.Random(3)
    rows = []
    for c in [*range(-3, 50), 199, 2**40]:
        for t in range(dice.choice([0, 1, 2, 3, 6, 9])):
            rows.append((c, dice.choice([t, t, t, None]), dice.choice(["user", "bot", None]), dice.choice(["a b", "a  b\tc", "", None, "é"])))
    rows += rows[:7] + [(None, 1, "user", "no one's")]
    dice.shuffle(rows)
    check(spark, rows)


@pytest.mark.parametrize("piece", [8192, 3])
def test_copies_ladders_and_long_ones(spark, monkeypatch, piece):
    monkeypatch.setattr(trie, "PIECE_IDS", piece)
    same = [(c * 20, t, "user", f"turn {t} of all") for c in range(40) for t in range(30)]
    long = [(2000 + c * 20, t, "user", f"turn {t}" if t < 60 or c == 0 else f"own {c}") for c in range(3) for t in range(70)]
    ladder = [(4000 + c * 20, t, "bot", "step" if t < c else f"{c} leaves") for c in range(6) for t in range(c + 2)]
    check(spark, same + long + ladder)


def test_small_tables(spark):
    assert trie.prefix_trie(spark.createDataFrame([], SHAPE)).count() == 0
    check(spark, [(7, None, None, None)])
    check(spark, [(1, 1, "user", "only")])
    check(spark, [(40, 1, "a", "b"), (41, 1, "a", "b"), (42, 1, "ab", "")])
    odd = spark.createDataFrame([(3, 1, "u", "x y", 1, 2, 3), (3, 2, "u", "z", 1, 2, 3)], SHAPE + ", conv int, depth int, key int")
    assert trie.prefix_trie(odd).count() == len(plain([(3, 1, "u", "x y"), (3, 2, "u", "z")]))
