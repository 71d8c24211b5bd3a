"""Packing whole documents into fixed windows by minimum bin slack."""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelforge.llm import kernels as K
from panelforge.llm.storage import small_batches, stored

CAPACITY = 4096
END_ID = 2
CACHE_WORDS = 400_000
#: Fixed value: the pre-token pattern that the chunk memory was made for.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: White space to Python's split but not to the tokenizer: texts with it are encoded whole.
ODD = re.compile("[\x1c-\x1f]")
#: Beyond Latin Extended-B, and dotted capital I: letters whose case or composition may depend on more than themselves.
BEYOND = re.compile("[^\x00-\u012f\u0131-\u024f]")
#: A comma or full stop that ends a word is a pre-token of its own.
TAIL = re.compile("(?<=[a-z\u00e0-\u00f6\u00f8-\u00ff0-9])([.,])(?=\\s)")
#: What is one pre-token as a whole.
LETTERS = re.compile("[a-z\u00e0-\u00f6\u00f8-\u00ff]+")


def splits_at_blanks(about: dict) -> bool:
    """Whether a tokenizer lower-cases, parts texts at white space, letters and other signs, and marks word ends.

    about: its JSON description. Only the very steps that the chunk memory was made for count.
    """
    steps = (about.get("normalizer") or {}).get("normalizers") or []
    parts = (about.get("pre_tokenizer") or {}).get("pretokenizers") or []
    pattern = (parts[0].get("pattern") or {}).get("Regex") if parts else None
    plain = [s["type"] for s in steps] == ["NFC", "Replace", "Lowercase"] and steps[1].get("pattern") == {"Regex": "\\s+"} and steps[1].get("content") == " "
    split = [p["type"] for p in parts] == ["Split", "ByteLevel"] and pattern == SPLIT and parts[0].get("invert") and not parts[1].get("add_prefix_space") and not parts[1].get("use_regex")
    return bool(plain and split and about["model"].get("type") == "BPE" and about["model"].get("end_of_word_suffix") == "</w>")


class Encoder:
    """Token ids of whole texts, with a bounded memory of the ids of each white-space-delimited chunk.

    The tokenizer's pre-tokens never span white space and its normaliser acts inside chunks, so the ids of
    a text are those of its chunks in order (tests hold this against plain encoding). Lower-casing a plain
    text and parting its full stops first changes no id and makes chunks repeat more. Chunks that were not
    seen for CACHE_WORDS new ones are forgotten. All of this rests on what `splits_at_blanks` looks for in the
    tokenizer's own description; the texts of any other tokenizer are encoded whole.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.whole = not splits_at_blanks(json.loads(self.tokenizer.to_str()))
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _plain(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _fresh(self, chunks: list[str]) -> None:
        """Learn these chunks: words of plain letters many at a time (one pre-token each, so the ids part at word ends)."""
        alike, rest = [], []
        for c in chunks:
            (alike if LETTERS.fullmatch(c) else rest).append(c)
        for at in range(0, len(alike), 4000):
            part = alike[at : at + 4000]
            (ids,) = self._plain([" ".join(part)])
            after = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            raw = ids.tobytes()
            self.known.update(zip(part, [raw[a:b] for a, b in zip([0, *after[:-1]], after, strict=True)], strict=True))
        self.known.update(zip(rest, [x.tobytes() for x in self._plain(rest)], strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if self.whole:
            return [x.tobytes() for x in self._plain(texts)]
        if len(self.known) > CACHE_WORDS:
            self.known, self.older = {}, self.known
        split = [None if ODD.search(t) else (t if BEYOND.search(t) else TAIL.sub(r" \1", t.lower())).split() for t in texts]
        new = set().union(*(s for s in split if s)).difference(self.known)
        again = new & self.older.keys()
        self.known.update((c, self.older[c]) for c in again)
        self._fresh(list(new - again))
        get = self.known.__getitem__
        return [self._plain([t])[0].tobytes() if s is None else b"".join(map(get, s)) for t, s in zip(texts, split, strict=True)]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each Python worker, which outlives its tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, task int, nth long"


def pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Cut every tokenised document at multiples of capacity.

    task, nth: the piece is the nth of its length that the task made. with_ids: also the ids (array<int>).
    """
    small_batches(docs.sparkSession)
    schema = PIECES + (", input_ids array<int>" if with_ids else "")
    tail = np.array([end_id], "<u4").tobytes()
    step = capacity * 4

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = encoder(path)
        task = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            _, off = K.text_buffers(batch.column(1))
            for a, b in K.slices(off, 4_000_000):  # many texts at once, so that each chunk is looked up once for all
                ids = batch.column(0).slice(a, b - a).to_pylist()
                texts = [t or "" for t in batch.column(1).slice(a, b - a).to_pylist()]
                rows: list[tuple] = []
                kept: list[np.ndarray] = []
                for doc, raw in zip(ids, ids_of.encode(texts), strict=True):
                    raw += tail
                    for at in range(0, len(raw), step):
                        piece = raw[at : at + step]
                        n = len(piece) // 4
                        rows.append((doc, at // 4, n, zlib.crc32(piece), len(raw) // 4, task, int(seen[n])))
                        seen[n] += 1
                        if with_ids:
                            kept.append(np.frombuffer(piece, "<i4"))
                cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [*[pa.int64()] * 5, pa.int32(), pa.int64()], strict=True)]
                if with_ids:
                    cols.append(pa.array(kept, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "task", "nth", *["input_ids"] * with_ids])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(K.tidy(cut), schema)


def fill(counts: np.ndarray, capacity: int) -> list[int]:
    """Lengths (a multiset, longest first) that fill one window as closely as any choice can.

    The longest length left opens the window, so every window makes progress. The rest is a subset sum
    with bounded counts: reach is a bitset (bit s: sum s can be met); lengths enter in binary multiples of
    their count, and the parts are kept so that the best sum can be traced back.
    """
    lengths = np.flatnonzero(counts)[::-1].tolist()
    first = lengths[0]
    room = capacity - first
    trail: list[tuple[int, int, int]] = []  # (length, multiple, bitset before it)
    reach, full = 1, (1 << (room + 1)) - 1
    for size in lengths:
        if size > room:
            continue
        left = min(int(counts[size]) - (size == first), room // size)
        part = 1
        while left > 0:
            take = min(part, left)
            grown = (reach | reach << (size * take)) & full
            if grown != reach:
                trail.append((size, take, reach))
                reach = grown
            left -= take
            part *= 2
        if reach >> room & 1:
            break
    best = reach.bit_length() - 1
    out = [first]
    for size, take, before in reversed(trail):
        if not before >> best & 1:
            out += [size] * take
            best -= size * take
    return out


def plan(counts: np.ndarray, capacity: int) -> list[tuple[int, list[int]]]:
    """(times, lengths) of every window pattern; all counts are used up.

    counts[s]: pieces of length s. A pattern is repeated as long as its counts last, and each use ends with
    some length below its multiplicity, so there are about as many patterns as distinct lengths, however
    many pieces there are.
    """
    counts = counts.copy()
    out = []
    while counts.any():
        pattern = fill(counts, capacity)
        need = np.bincount(pattern, minlength=capacity + 1)
        used = need > 0
        times = int((counts[used] // need[used]).min())
        counts -= need * times
        out.append((times, pattern))
    return out


def _slots(patterns: list[tuple[int, list[int]]]) -> pd.DataFrame:
    """One row per length and pattern: ranks [first, first + times * many) of the length go to the pattern."""
    rows, used, sequence = [], {}, 0
    for times, lengths in patterns:
        at = 0
        for size in dict.fromkeys(lengths):
            many = lengths.count(size)
            first = used.get(size, 0)
            rows.append((size, first, first + times * many, many, sequence, at))
            used[size] = first + times * many
            at += many * size
        sequence += times
    return pd.DataFrame(rows, columns=["length", "first", "after", "many", "sequence", "at"], dtype="int64")


def assign(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """cut (stored pieces) with sequence_id and offset.

    What reaches the driver and is broadcast: the count of each length (capacity numbers) and the pattern
    slots, both bounded by capacity alone. A piece's rank among those of its length is its nth in the task
    plus what earlier tasks made of that length: sums of per-task counts, never of pieces.
    """
    per_task = cut.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = per_task.withColumn("base", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    counts = np.zeros(capacity + 1, np.int64)
    for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect():
        counts[r["length"]] = r["n"]
    slots = _slots(plan(counts, capacity)).sort_values(["length", "first"])
    by = {int(k): v.to_numpy() for k, v in slots.groupby("length")[["first", "many", "sequence", "at"]]}
    table = cut.sparkSession.sparkContext.broadcast(by)
    ranked = cut.join(base.select("length", "task", "base").hint("merge"), ["length", "task"]).withColumn("rank", F.col("base") + F.col("nth"))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        size, r = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        out = np.zeros((len(size), 2), np.int64)
        for s in np.unique(size):
            mine = np.flatnonzero(size == s)
            t = table.value[int(s)]
            row = t[np.searchsorted(t[:, 0], r[mine], "right") - 1]
            nth = r[mine] - row[:, 0]
            out[mine, 0] = row[:, 2] + nth // row[:, 1]
            out[mine, 1] = row[:, 3] + nth % row[:, 1] * s
        return pd.DataFrame(out, columns=["sequence_id", "offset"])

    return ranked.withColumn("p", place("length", "rank")).select(*[c for c in cut.columns if c not in ("task", "nth")], "p.sequence_id", "p.offset")


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, [input_ids,] sequence_id, offset.

    Every id of every document (its text's ids, then end_id) lies in exactly one piece; pieces lie gapless
    from 0 in sequences of at most capacity ids. A null or empty text is the single end_id. Repeated rows
    are packed once each. An empty table gives no rows. Other columns are not read.
    """
    return assign(stored(pieces(docs, path, id_col, text_col, capacity, end_id, with_ids), "pieces"), capacity)


def sequences(packed: DataFrame, capacity: int = CAPACITY, pad_id: int = 0) -> DataFrame:
    """Rows of pack(with_ids=True) as one row per sequence: sequence_id, input_ids padded to capacity, attention length.

    A sequence holds at most capacity ids, so what is gathered for one is bounded.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", "input_ids")))
    ids = F.flatten(F.transform(parts, lambda p: p["input_ids"]))
    return packed.groupBy("sequence_id").agg(ids.alias("ids")).select("sequence_id", F.concat("ids", F.array_repeat(F.lit(pad_id), F.lit(capacity) - F.size("ids"))).alias("input_ids"), F.size("ids").alias("n_ids"))
