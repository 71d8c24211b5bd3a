"""Each stage of the corpus pipeline against brute force on what the stage before it kept."""

import collections
import re

import corpus_pipeline

FOLDER = "/root/testdata/sf0.001"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def texts(df):
    return {r["doc_id"]: r["text"] or "" for r in df.collect()}


def test_stages(spark, tmp_path):
    read = lambda name: spark.read.parquet(f"{FOLDER}/{name}.parquet")
    docs = read("documents")
    before, columns = texts(docs), docs.columns
    kept, packed = [], None
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, FOLDER).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        if i < 4:
            assert docs.columns == columns
            kept.append(texts(docs))
            assert all(before[d] == t for d, t in kept[-1].items())
        else:
            packed = docs
    rated, near, clean, exact = kept[0], kept[2], kept[3], kept[1]

    labels = {r["doc_id"]: (r["quality"], r["toxic"]) for r in read("labels").collect()}
    good = [d for d, (q, t) in labels.items() if q == 1 and not t]
    assert sum(d in rated for d in good) >= 0.9 * len(good)

    groups = collections.defaultdict(list)
    for d, t in rated.items():
        groups[t.translate(LOW)].append(d)
    assert set(exact) == {max(g) for g in groups.values()}

    sets = {}
    for d, t in exact.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", t.translate(LOW))
        sets[d] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {d: d for d in sets}
    find = lambda x: x if root[x] == x else find(root[x])
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                root[max(find(a), find(b))] = min(find(a), find(b))
    assert set(near) == {d for d in ids if find(d) == d}

    word = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate(LOW))
    windows = collections.defaultdict(set)
    for r in read("benchmark").collect():
        w = word(r["text"] or "")
        n = min(10, len(w))
        if n:
            windows[n] |= {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
    dirty = {d for d, t in near.items() for n, known in windows.items() if any(tuple(word(t)[k : k + n]) in known for k in range(len(word(t)) - n + 1))}
    assert set(clean) == set(near) - dirty

    pieces = collections.defaultdict(int)
    for r in packed.collect():
        pieces[r["doc_id"]] += r["length"]
        assert r["offset"] + r["length"] <= 4096
    assert set(pieces) == set(clean) and all(pieces[r["doc_id"]] == r["doc_tokens"] for r in packed.collect())
    assert corpus_pipeline.run(spark, FOLDER).count() == packed.count()
