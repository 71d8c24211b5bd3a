"""The ordinal model against a plain statement of its likelihood."""

import math
import tracemalloc

import numpy as np
import pyarrow as pa

from panelforge.llm import quality


def made(n=400, seed=0):
    rng = np.random.default_rng(seed)
    truth = rng.normal(size=12)
    lists, grade = [], []
    for _ in range(n):
        mine = np.flatnonzero(rng.random(12) < 0.4)
        score = truth[mine].sum() + rng.logistic()
        lists.append(mine.astype(np.int32))
        grade.append(int(score > -0.5) + int(score > 1.0))
    off = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
    return np.concatenate(lists), off, np.array(grade), lists


def loss(weights, thresholds, lists, grade, ridge=3e-4, most=quality.MOST_WEIGHT):
    """The mean negative log likelihood, rare grades weighed up, plus the ridge: row by row."""
    have = np.bincount(grade, minlength=3)
    w = [min(have.max() / max(have[g], 1), most) for g in grade]
    total = 0.0
    for x, g, k in zip(lists, grade, w):
        s = sum(weights[i] for i in x)
        below = [0.0] + [1 / (1 + math.exp(-(t - s))) for t in thresholds] + [1.0]
        total -= k * math.log(below[g + 1] - below[g])
    return total / sum(w) + ridge / 2 * float((weights**2).sum())


def test_fit_is_the_optimum():
    ids, off, grade, lists = made()
    model = quality.fit(ids, off, grade, rounds=3000, rate=0.02, least_z=0.0)
    w, t = model.weights[:12].astype(float), model.thresholds
    best = loss(w, t, lists, grade)
    rng = np.random.default_rng(1)
    for _ in range(60):
        dw, dt = rng.normal(size=12) * 0.05, rng.normal(size=2) * 0.05
        assert loss(w + dw, t + dt, lists, grade) > best - 1e-6
    assert not model.weights[12:].any() and t[0] < t[1]


def test_probabilities_by_hand():
    model = quality.OrdinalModel(np.array([0.5, -1.0, 2.0]), np.array([-0.2, 1.3]))
    p = model.probabilities(model.score(np.array([0, 2, 1]), np.array([0, 2, 3, 3])))
    for row, s in zip(p, (2.5, -1.0, 0.0)):
        a, b = (1 / (1 + math.exp(-(t - s))) for t in (-0.2, 1.3))
        assert np.allclose(row, [a, b - a, 1 - b])


def test_evidence_is_chosen_by_held_out_rows():
    ids, off, grade, _ = made(900)
    z = quality.held_out_evidence(ids, off, grade, 3, 0.05, 3e-4, quality.MOST_WEIGHT)
    test = np.arange(len(grade)) % 3 == 0
    means = []
    for e in quality.EVIDENCE:
        m = quality.fit(*quality._rows(ids, off, ~test), grade[~test], 3, 150, 0.05, 3e-4, e, quality.MOST_WEIGHT)
        p = m.probabilities(m.score(*quality._rows(ids, off, test)))
        means.append(np.log(p[np.arange(len(p)), grade[test]]).mean())
    assert z == quality.EVIDENCE[int(np.argmax(means))]
    assert quality.held_out_evidence(ids[: off[1]], off[:2], grade[:1], 3, 0.05, 3e-4, 4.0) == quality.EVIDENCE[0]


def test_fit_holds_little_besides_the_lists(monkeypatch):
    """Its memory is that of the lists and of the features, not several times the lists; the driver has little more."""
    rng = np.random.default_rng(2)
    size = rng.integers(500, 1500, 2000)
    ids = np.concatenate([rng.choice(20_000, n, replace=False) for n in size]).astype(np.int32)
    off, grade = np.concatenate([[0], np.cumsum(size)]), rng.integers(0, 3, len(size))
    monkeypatch.setattr(quality, "EVIDENCE", (0.0,))
    tracemalloc.start()
    try:
        model = quality.fit(ids, off, grade, rounds=2)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 1.5 * ids.nbytes + 20e6, peak
    assert model.weights[:20_000].any() and not model.weights[20_000:].any()


def test_slices_do_not_change_the_fit(monkeypatch):
    ids, off, grade, _ = made(300, 3)
    pick = np.arange(300) % 3 != 0
    whole = quality.fit(ids, off, grade, rounds=50, least_z=1.0)
    part = quality.fit(*quality._rows(ids, off, pick), grade[pick], rounds=50, least_z=1.0)
    scores = whole.score(ids, off)
    monkeypatch.setattr(quality, "SLICE", 7)
    for model, again in ((whole, quality.fit(ids, off, grade, rounds=50, least_z=1.0)), (part, quality.fit(ids, off, grade, rounds=50, least_z=1.0, rows=pick))):
        assert np.array_equal(model.weights, again.weights) and np.array_equal(model.thresholds, again.thresholds) and model.weights.any()
    assert np.array_equal(whole.score(ids, off), scores)


def test_batches_are_fitted_in_order_of_id():
    ids, off, grade, lists = made(200, 4)
    mixed = np.random.default_rng(5).permutation(200)
    batches = [pa.record_batch([pa.array(part), pa.array(grade[part], pa.int32()), pa.array([lists[i] for i in part], pa.list_(pa.int32()))], ["doc_id", "grade", "ids"]) for part in np.array_split(mixed, 7)]
    batches = [batches[0].slice(0, 4), batches[0].slice(4), *batches[1:]]
    got, want = quality._fit_batches(batches), quality.fit(ids, off, grade)
    assert not batches and np.array_equal(got.weights, want.weights) and np.array_equal(got.thresholds, want.thresholds)
