"""The quality query and stage against a plain refit, text by text, and what becomes of poor and toxic texts."""

import math
import re
from functools import cache

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest

from panelforge.llm import kernels as K
from panelforge.llm import quality
from panelforge.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.01"
MASK = (1 << quality.BITS) - 1
LOW = {c: c + 32 for c in range(65, 91)}


@cache
def word_ids(word):
    """The numbers of one word and of its stems."""
    data, off = K.text_buffers(pa.array([word]))
    starts, ends, h, _ = K.words(data, off, K.ALNUM_WORD, lower=True)
    return frozenset(int(x[0]) & MASK for x in (h, *(K.word_prefixes(data, starts, ends, k, k) for k in quality.STEMS)))


def plain_features(text):
    raw = (text or "").encode()
    size = max(len(raw), 1)
    share = lambda *spans: sum(any(a <= b <= z for a, z in spans) for b in raw) / size
    blank = [w.translate(LOW) for w in re.findall("[^\x20\x09-\x0d]+", text or "")]
    n = max(len(blank), 1)
    shape = [share((65, 90)), share((48, 57)), share((33, 43), (58, 64), (91, 96), (123, 126)), share((9, 13), (32, 32)), 1 - len(set(blank)) / n, sum(a == b for a, b in zip(blank, blank[1:], strict=False)) / n]
    ids = {int(K.mix(np.array([min(int(v * 20), 20) + 64 * i], np.uint64), 5)[0]) & MASK for i, v in enumerate(shape)}
    for w in set(re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOW))):
        ids |= word_ids(w)
    return sorted(ids)


@pytest.fixture(scope="module")
def refit(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    rated = {r["doc_id"]: r["grade"] for r in quality.graded(spark.read.parquet(f"{FOLDER}/labels.parquet")).collect()}
    feature = {r["doc_id"]: plain_features(r["text"]) for r in docs}
    order = sorted(i for i in rated if i in feature)
    ids = np.array([x for i in order for x in feature[i]], np.int32)
    model = quality.fit(ids, np.cumsum([0, *(len(feature[i]) for i in order)]), np.array([rated[i] for i in order]))
    scores = {i: sum(float(model.weights[x]) for x in f) for i, f in feature.items()}
    tail = {i: 1 - 1 / (1 + math.exp(-(model.thresholds[-1] - s))) for i, s in scores.items()}
    low = {i: 1 / (1 + math.exp(-(model.thresholds[0] - s))) for i, s in scores.items()}
    return tail, {i: 1 - low[i] + tail[i] for i in tail}, rated


def test_query_against_a_plain_refit(spark, refit):
    tail, grade, rated = refit
    got = {r["doc_id"]: r for r in QUERIES["op5_quality"](spark, FOLDER).collect()}
    assert set(got) == {i for i, p in tail.items() if p >= 0.5} and 0 < len(got) < len(tail)
    assert all(abs(r["p_top"] - tail[i]) < 1e-5 and abs(r["expected_grade"] - grade[i]) < 1e-5 and r["kept"] for i, r in got.items())


def test_stage_lets_poor_and_toxic_texts_go(spark, refit):
    tail, _, rated = refit
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    stay = {r["doc_id"] for r in corpus_pipeline.quality_stage(spark, docs, FOLDER).select("doc_id").collect()}
    assert stay == {i for i, p in tail.items() if p >= 0.5}
    share = lambda g: np.mean([i in stay for i in rated if rated[i] == g and i in tail])
    assert share(2) > 0.9 and share(0) < 0.1 and share(1) < 0.5, (share(2), share(0), share(1))
