"""Retrieval of damaged licenses by window signatures, against containment counted on all shingles."""

import random
import re
from pathlib import Path

import pytest

from panelforge.llm import licenses

LONG = Path("/usr/share/common-licenses")


def word(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower())


def shingles(w):
    k = min(5, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def test_recall_of_damaged_templates(spark):
    rng = random.Random(3)
    made = {f"made{n}": " ".join(f"v{rng.randrange(10**6)}" for _ in range(n)) for n in (14, 20, 43, 44, 45, 70, 300, 2500)}
    texts = []
    for name, t in {**licenses.TEMPLATES, **made}.items():
        for _ in range(25):
            w = word(t)
            for _ in range(rng.randrange(0, max(1, len(w) // 25) + 1)):
                w[rng.randrange(len(w))] = f"z{rng.randrange(10**6)}"
            before, after = ([f"y{rng.randrange(10**6)}" for _ in range(rng.randrange(0, 90))] for _ in range(2))
            texts.append(" ".join(before + w + after))
    known = {**licenses.TEMPLATES, **made}
    sets = {k: shingles(word(t)) for k, t in known.items()}
    size = {k: min(5, len(word(t))) for k, t in known.items()}
    want = set()
    for i, t in enumerate(texts):
        w = word(t)
        own = {k: {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} for k in set(size.values())}
        want |= {(i, k) for k, s in sets.items() if len(s & own[size[k]]) >= licenses.LEAST * len(s)}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {(r["doc_id"], r["license_id"]) for r in licenses.license_scan(docs, known).collect()}
    assert got <= want and len(want) > 700 and len(got) >= 0.999 * len(want)


@pytest.mark.skipif(not LONG.is_dir(), reason="no license texts on this machine")
def test_full_texts(spark):
    full = {f.name: f.read_text(errors="replace") for f in LONG.iterdir() if f.is_file() and not f.is_symlink()}
    docs = spark.createDataFrame([(i, f"some code here\n{t}\nmore code") for i, t in enumerate(full.values())], "doc_id long, text string")
    got = {(r["doc_id"], r["license_id"]) for r in licenses.license_scan(docs, full).collect()}
    assert {(i, k) for i, k in enumerate(full)} <= got
