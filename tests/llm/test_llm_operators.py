"""The training-text operators against brute force on a small fixture with nulls, ties, repeats and clashing columns."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from panelforge.llm import decontaminate, exact_dedup, html_extract, kernels, licenses, line_dedup, minhash, packing, quality, substring, suffix
from panelforge.llm.queries import TOKENIZER

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
FIELDS = "doc_id long, text string, digest string, run string, anchor string, spans string, words string, place string, node string, kept string"
SCHEMA = FIELDS


def made_texts():
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(60)] + ["Über", "naïve", "straße", "İx", "x-y", "3.5"]
    passage = " ".join(rng.choice(vocab) for _ in range(70))
    base = [" ".join(rng.choice(vocab) for _ in range(rng.randint(30, 160))) for _ in range(12)]
    texts = list(base)
    texts += [base[0], base[0].upper(), base[1] + " tail", "head " + base[2], base[3].replace(" ", "\n", 20)]
    texts += [f"{base[4]} {passage} {base[5]}", f"{base[6]}\n{passage}\n{base[7]}", passage]
    words = base[8].split()
    texts += [" ".join(words[:k] + ["edited"] + words[k + 1 :]) for k in (3, 40, 41)]
    texts += ["on, " * 200, "aaaa" * 90, "\n".join(["a b", "c d", "e f", "g h"] * 12), "x\ny\nz\nx\ny\nz"]
    notice = "\n".join(f"line {i} of the notice" for i in range(30))
    texts += ["top\n" + notice, "other\nhead\n" + notice + "\nend", notice]
    texts += [None, None, "", "", " \n\t ", "one", "two words", "All rights reserved.", "Licensed under the Apache License, Version 2.0. " + base[9], "é   z"]
    texts += ["word " * 9000 + passage]
    return texts


@pytest.fixture(scope="module")
def rows():
    return [(i * 3 + 1, t) for i, t in enumerate(made_texts())]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, *["c"] * 8) for i, t in rows], SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    return {r["doc_id"]: r.asDict() for r in df.collect()}


def sha(raw):
    return hashlib.sha256(raw).hexdigest()


def blank_words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_kernels_match_plain_code():
    texts = ["", "Ab ab  cd", None, "xxé éxx", "z"]
    data, off = kernels.text_buffers(pa.array(texts))
    s, e, h, at = kernels.words(data, off, kernels.BLANK_WORD, lower=True)
    got = [[bytes(data[a:b]).lower() for a, b in zip(s[i:j], e[i:j])] for i, j in zip(at[:-1], at[1:])]
    assert got == [[w.lower().encode() for w in blank_words(t)] for t in texts]
    assert h[0] == h[1] != h[2]
    x = np.arange(50, dtype=np.uint64) % np.uint64(7)
    for k in (1, 2, 3, 5, 24):
        g = kernels.grams(x, k)
        assert len(g) == 51 - k and all((g[i] == g[j]) == (i % 7 == j % 7) for i in range(20) for j in range(20))
        assert (kernels.sliding(x, k, np.minimum) == [x[i : i + k].min() for i in range(51 - k)]).all()


def test_exact_dedup(spark, docs, rows, nothing):
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[(t or "").translate(LOW)].append(i)
    got = by_id(exact_dedup.exact_dedup(docs))
    assert len(got) == len(rows)
    for text, ids in groups.items():
        for i in ids:
            assert (got[i]["keep_id"], got[i]["group_size"], got[i]["kept"], got[i]["text_sha256"]) == (max(ids), len(ids), i == max(ids), sha(text.encode()))
    assert exact_dedup.exact_dedup(nothing).count() == 0
    twice = exact_dedup.exact_dedup(spark.createDataFrame([(None, "a"), (None, "a"), (5, "b"), (5, "b")], "doc_id long, text string")).collect()
    assert len(twice) == 4 and all(r["kept"] for r in twice)


def test_decontamination(spark, docs, rows, nothing):
    texts = dict(rows)
    some = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", texts[1].translate(LOW))
    items = [(1, " ".join(some[2:20])), (12, "Rights RESERVED"), (3, None), (4, ""), (5, " ".join(some[:12])), (12, "rights reserved"), (None, "one")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    word = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))
    for block in (16_000_000, 150):
        got = by_id(decontaminate.hit_digest(decontaminate.benchmark_hits(docs, bench, block_bytes=block)))
        for i, t in rows:
            w, hit, found = word(t), set(), set()
            for item, x in items:
                v = word(x)
                if item is None or not v:
                    continue
                n = min(10, len(v))
                for a in range(len(v) - n + 1):
                    for b in range(len(w) - n + 1):
                        if w[b : b + n] == v[a : a + n]:
                            hit |= set(range(b, b + n))
                            found.add(str(item))
            want = (len(w), len(hit), len(found), sha(",".join(sorted(found)).encode()), bool(hit))
            assert tuple(got[i][c] for c in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")) == want
    assert decontaminate.benchmark_hits(nothing, bench).count() == 0
    assert decontaminate.benchmark_hits(docs, bench.limit(0)).filter("size(spans) > 0").count() == 0


@pytest.mark.parametrize("percent", [80, 85])
def test_minhash_links_are_exact(docs, rows, nothing, percent):
    sets = {}
    for i, t in rows:
        w = blank_words((t or "").translate(LOW))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {i: i for i in sets}
    find = lambda x: x if root[x] == x else find(root[x])
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                root[max(find(a), find(b))] = min(find(a), find(b))
    got = by_id(minhash.near_duplicates(docs, percent=percent))
    assert {i: (got[i]["n_shingles"], got[i]["component_id"], got[i]["kept"]) for i in sets} == {i: (len(sets[i]), find(i), find(i) == i) for i in sets}
    assert minhash.near_duplicates(nothing).count() == 0


def test_large_buckets_are_taken_in_portions(docs, monkeypatch):
    want = by_id(minhash.near_duplicates(docs))
    monkeypatch.setattr(minhash, "HELD_ROWS", 2)
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 62, 3).astype(np.uint64)
    sketch = np.array([base[i % 3] ^ np.uint64(1 << (i % 5)) for i in range(30)])
    table = pa.Table.from_arrays([pa.array([7] * 30), pa.array(range(30)), pa.array(kernels.signed(sketch))], ["key", "doc", "sketch"])
    for size in (1, 4, 100):
        root = list(range(30))
        find = lambda x: x if root[x] == x else find(root[x])
        edges = [r for b in minhash._candidates(iter(table.to_batches(size))) for r in b.to_pylist()]
        for r in edges:
            root[find(r["a"])] = find(r["b"])
        assert len(edges) < 60 and all((find(i) == find(j)) == (i % 3 == j % 3) for i in range(30) for j in range(30))
    assert by_id(minhash.near_duplicates(docs)) == want


def test_large_families_are_cut_in_blocks(spark, monkeypatch):
    rng = random.Random(1)
    base = [f"t{rng.randrange(5000)}" for _ in range(200)]
    texts = []
    for _ in range(40):
        w = list(base)
        for k in rng.sample(range(200), rng.randrange(1, 6)):
            w[k] = f"n{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    whole = by_id(minhash.near_duplicates(df))
    monkeypatch.setattr(minhash, "FAMILY_DOCS", 10)
    assert by_id(minhash.near_duplicates(df)) == whole


def test_substring(docs, rows, nothing):
    w = {i: blank_words(t) for i, t in rows}
    seen = collections.Counter(tuple(x[k : k + 35]) for x in w.values() for k in range(len(x) - 34))
    got = by_id(substring.word_dedup(docs))
    for i, x in w.items():
        gone = {p for k in range(len(x) - 34) if seen[tuple(x[k : k + 35])] > 1 for p in range(k, k + 35)}
        kept = " ".join(v for p, v in enumerate(x) if p not in gone).encode()
        assert (got[i]["n_words"], got[i]["n_removed"], bytes(got[i]["kept"])) == (len(x), len(gone), kept)
    assert substring.word_dedup(nothing).count() == 0


def bytes_brute(rows, span=100):
    seen, out = set(), {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - span + 1):
            if b[k : k + span] in seen:
                gone[k : k + span] = True
            seen.add(b[k : k + span])
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        runs = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(b) else 0
        out[i] = (len(b), int(gone.sum()), runs, kept)
    return out


def test_suffix_array(docs, rows, nothing):
    got = by_id(suffix.byte_dedup(docs))
    assert {i: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for i, r in got.items()} == bytes_brute(rows)
    assert suffix.byte_dedup(nothing).count() == 0


@pytest.mark.parametrize("held", [1, 2, 5])
def test_hot_anchors_are_compared_by_window(spark, monkeypatch, held):
    import panelforge.llm.repeats as repeats

    rng = random.Random(7)
    passage = " ".join(f"p{rng.randrange(900)}" for _ in range(60))
    texts = [f"{' '.join(f'a{rng.randrange(9**6)}' for _ in range(30))} {passage} {' '.join(f'b{rng.randrange(9**6)}' for _ in range(30))}" for _ in range(25)]
    texts += [texts[3] + " more", "zz " + texts[4], "again " * 300, "again " * 290 + passage]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    word_want = by_id(substring.word_dedup(df))
    monkeypatch.setattr(repeats, "HELD_ROWS", held)
    assert spark.conf.get("spark.master").startswith("local")
    for shape, look in ((repeats.Shape("byte", 100, 24, True), suffix._look), (repeats.Shape("word", 35, 16, False), substring._look)):
        runs = []
        for i, t in rows:
            u = repeats.Units(pa.array([t]), shape.unit)
            runs.append(u)
        batches = list(repeats._emit_runs(shape)(iter([pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows]), pa.array(texts)], ["doc_id", "text"])])))
        table = pa.Table.from_batches(batches).sort_by([(c, "ascending") for c in ("anchor", "class", "doc_id", "place")])
        for size in (1, 3, 1000):
            met = pa.Table.from_batches(list(repeats._meet(shape)(iter(table.to_batches(size)))))
            looks = collections.defaultdict(list)
            spans = collections.defaultdict(set)
            for r in met.to_pylist():
                if r["look"]:
                    looks[r["doc_id"]].append({k: r[k] for k in ("place", "anchor", "sure", "many")})
                if r["sure"]:
                    lo, n, _ = repeats.unpacked(np.array([r["place"]]))
                    spans[r["doc_id"]] |= set(range(int(lo[0]), int(lo[0] + n[0])))
            kind = pa.list_(pa.struct([("place", pa.int64()), ("anchor", pa.int64()), ("sure", pa.bool_()), ("many", pa.bool_())]))
            docs = pa.RecordBatch.from_arrays([pa.array([i for i in looks]), pa.array([texts[i] for i in looks]), pa.array(list(looks.values()), kind)], ["doc_id", "text", "looks"])
            fetched = pa.Table.from_batches(list(repeats._fetch(shape)(iter([docs]))))
            by_key = [(c, "ascending") for c in ("anchor", "second", "doc_id", "place")]
            few, lot = (fetched.filter(m).sort_by(by_key) for m in (fetched["units"].is_valid(), fetched["units"].is_null()))
            assert lot.num_rows > 0 or size > 1
            for out in (*look(shape)(iter(few.to_batches())), *repeats._same_windows(shape)(iter(lot.to_batches(size)))):
                for r in out.to_pylist():
                    spans[r["doc_id"]] |= set(range(r["lo"], r["lo"] + r["n"]))
            for i, t in rows:
                units = list(t.encode()) if shape.unit == "byte" else blank_words(t)
                gone = {p for s in spans[i] for p in range(s, s + shape.span)}
                if shape.unit == "byte":
                    want = bytes_brute(rows)[i][1]
                else:
                    want = word_want[i]["n_removed"]
                assert len(gone) == want, (shape.unit, size, i, len(units))


def test_long_texts_go_in_segments(spark, rows, monkeypatch):
    import panelforge.llm.repeats as repeats

    monkeypatch.setattr(repeats, "SEGMENT", 700)
    codes = kernels.BYTE_CODES[np.frombuffer("".join(t or "" for _, t in rows).encode(), np.uint8)]
    row, lo, count, before, _, _ = repeats.runs_of(codes, np.array([0, len(codes)]), repeats.Shape("byte", 100, 24, True))
    assert (lo[1:] == lo[:-1] + count[:-1]).all() and count.sum() == len(codes) - 99 and (before < 77).all() and not row.any()


def test_interval_tree_of_a_known_string():
    s = b"banana"
    rows = np.zeros((6, 6), np.uint8)
    for i in range(6):
        rows[i, : 6 - i] = np.frombuffer(s[i:], np.uint8)
    have, group = np.arange(6, 0, -1), np.zeros(6, np.int64)
    order = suffix.suffix_order(rows, group)
    lcp = suffix.common_prefixes(rows, have, group, order)
    assert order.tolist() == [5, 3, 1, 0, 4, 2] and lcp.tolist() == [0, 1, 3, 0, 0, 2]
    assert sorted(suffix.intervals(lcp.tolist(), 1)) == [(1, 0, 0, 2), (2, 0, 4, 5), (3, 1, 1, 2)]


def test_packing(docs, rows, nothing):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(TOKENIZER)
    tok.encode_special_tokens = True
    ids = {i: np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for i, t in rows}
    packed = packing.pack(docs, TOKENIZER, with_ids=True)
    got = packed.collect()
    seen, places = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        piece = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(piece) == r["length"] and zlib.crc32(piece.tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(ids[r["doc_id"]])
        seen[r["doc_id"]] += range(r["start"], r["start"] + r["length"])
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    assert {i: sorted(x) for i, x in seen.items()} == {i: list(range(len(x))) for i, x in ids.items()}
    for pieces in places.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 4096
    total = sum(map(len, ids.values()))
    assert len(places) == -(-total // 4096)
    rows_out = packing.sequences(packed).collect()
    assert all(len(r["input_ids"]) == 4096 for r in rows_out) and sum(r["n_ids"] for r in rows_out) == total
    assert packing.pack(nothing, TOKENIZER).count() == 0


def test_slack_is_minimal():
    rng = np.random.default_rng(0)
    for _ in range(30):
        counts = np.zeros(41, np.int64)
        for x in rng.integers(1, 41, 9):
            counts[x] += 1
        pattern = packing.fill(counts, 40)
        first, pool = int(np.flatnonzero(counts).max()), []
        for s in np.flatnonzero(counts):
            pool += [int(s)] * int(counts[s] - (s == first))
        sums = {0}
        for s in pool:
            sums |= {a + s for a in sums if a + s + first <= 40}
        assert sum(pattern) == first + max(sums) and (np.bincount(pattern, minlength=41) <= counts).all()


def test_chunk_memory_changes_no_id(rows):
    enc = packing.Encoder(TOKENIZER)
    texts = [t or "" for _, t in rows] + ["Don't STOP!!! it's, a.b c.. d., ÄÖ ß. İstanbul. ΣΑΣ ΑΣ. a\x1cb x é. ,, . <|endoftext|> x<|endoftext|>y 12,3. ², ǅ. ŉ."]
    assert enc.encode(texts) == [x.tobytes() for x in enc._plain(texts)] == enc.encode(texts)


def page(body):
    return f'<html><head><title>t</title><style>p{{}}</style><script>var t="</p>";</script></head><body>{body}</body></html>'


def test_html(spark):
    long = "This is a sentence, with some words. " * 8
    pages = [
        (1, "u", page(f'<nav><a href="/">Home</a></nav><div class="ad">Buy!</div><article><h1>A &amp; B</h1><p><b>{long}<br><p>Fish&nbsp;&eacute;<p>x<i>y</i>z</p></article><aside>more</aside><footer>&copy;</footer>')),
        (2, "u", page(f'<div id="menu"><a>one</a> <a>two</a></div><div><p>{long}</p><p>{long}</p></div><div class="comments"><p>{long}</p></div><form>{long}</form><div class="cookie-notice">{long}</div>')),
        (3, None, None),
        (4, "u", ""),
        (5, "u", page("<!-- only a comment -->")),
        (5, "u", page("<article>short</article><div>" + long + "</div>")),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = sorted((r["page_id"], r["text"], r["n_chars"]) for r in html_extract.page_texts(df).collect())
    clean = " ".join(long.split())
    want = [(1, f"A & B {clean} Fish é xyz"), (2, f"{clean} {clean}"), (3, ""), (4, ""), (5, ""), (5, "short")]
    assert got == [(i, t, len(t)) for i, t in want]
    clash = df.withColumn("text", F.lit("old")).withColumn("n_chars", F.lit("old"))
    assert html_extract.extract(clash).filter("text = 'old'").count() == 0 and html_extract.extract(df.limit(0)).count() == 0


def test_licenses(docs, rows, nothing):
    word = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))
    got = {(r["doc_id"], r["license_id"], r["n_shared"]) for r in licenses.license_scan(docs).collect()}
    want = set()
    for i, t in rows:
        for name, x in licenses.TEMPLATES.items():
            v, w = word(x), word(t)
            k = min(5, len(v))
            a, b = {tuple(v[j : j + k]) for j in range(len(v) - k + 1)}, {tuple(w[j : j + k]) for j in range(len(w) - k + 1)}
            if len(a & b) >= 0.8 * len(a):
                want.add((i, name, len(a & b)))
    assert got == want and len(want) >= 2
    assert licenses.license_scan(nothing).count() == 0 and licenses.license_scan(docs, templates={}).count() == 0


def stretches_of(text):
    """(first, last) line of each stretch."""
    out, start, before = [], 0, ""
    lines = text.split("\n")
    for i, line in enumerate(lines):
        own = hashlib.md5(line.encode()).hexdigest()[:8]
        if (line.strip(" ") and hashlib.md5((before + own).encode()).hexdigest()[:2] < "f8") or i == len(lines) - 1:
            out.append((start, i))
            start = i + 1
        before = own
    return out


def test_line_dedup(docs, rows, nothing):
    first, chunks = {}, {}
    for i, t in rows:
        s = stretches_of(t) if t is not None else []
        chunks[i] = [(a, z, "\n".join(t.split("\n")[a : z + 1])) for (a, _), (_, z) in zip(s, s[1:], strict=False)]
        for a, _, body in chunks[i]:
            first.setdefault(body, (i, a))
    got = by_id(line_dedup.line_dedup(docs))
    removed = 0
    for i, t in rows:
        lines = t.split("\n") if t is not None else []
        gone = [(a, z) for a, z, body in chunks[i] if first[body] != (i, a)]
        out = {k for a, z in gone for k in range(a, z + 1)}
        removed += len(out)
        assert (got[i]["n_lines"], got[i]["n_removed"], got[i]["n_chunks"], got[i]["kept"]) == (len(lines), len(out), len(gone), "\n".join(x for k, x in enumerate(lines) if k not in out))
    assert removed > 0 and line_dedup.line_dedup(nothing).count() == 0


def test_quality_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rated = quality.graded(labels)
    learn, test = rated.filter("doc_id % 4 <> 0"), rated.filter("doc_id % 4 = 0")
    model = quality.train(docs, learn)
    assert (np.diff(model.thresholds) > 0).all()
    got = quality.grade(docs.join(test, "doc_id"), model).groupBy("grade").agg(F.avg(F.col("_selected").cast("int")).alias("s"), F.avg("_grade").alias("g")).collect()
    share, mean = {r["grade"]: r["s"] for r in got}, {r["grade"]: r["g"] for r in got}
    assert share[2] > 0.95 and share[0] < 0.1 and share[1] < 0.35
    assert mean[0] < mean[1] < mean[2]


def test_quality_without_ratings(spark, docs, rows, nothing):
    none = spark.createDataFrame([], "doc_id long, grade int")
    model = quality.train(docs, none)
    assert quality.grade(docs, model).filter("_selected").count() == len(rows)
    assert quality.grade(nothing, model).count() == 0
