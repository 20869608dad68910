"""Best-fit packing of token sequences by large-item matching.

Lengths are whole numbers up to the capacity, so what has to be packed is a histogram: `plan`
matches sizes above one third of the capacity at most twice per bin, greedily and largest first,
then lets smaller ones best-fit the remaining gaps.  It works on counts and whole ranges of bins; its
input and output have a few rows per size, however many documents there are.  The pieces take their places
by their rank among pieces of the same length, which needs counts per task but no common sort.
"""

from __future__ import annotations

import json
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, pieces

#: Entries after which a worker's cache of word tokens starts anew.
CACHE_ENTRIES = 250_000
#: Fixed value: the published pre-tokenizer pattern of this byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Encoder:
    """Token ids (little-endian uint32 bytes) of a text under a byte-level BPE file of the tokenizers library.

    A space before anything but white space always opens a pre-token, so such a text is the join of its
    space-separated chunks, and chunks are looked up in a cache.  Texts with a space before white space or at
    the end are encoded whole.  Texts that hold an added token, and all texts if the file describes any other kind of tokenizer, take
    the library's own path.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        self.special = tuple(x["content"] for x in told.get("added_tokens") or ())
        self.bpe, self.rest = None, {}
        if byte_level(told):
            byte = {c: b for b, c in _byte_chars().items()}
            ranks = {bytes(byte[c] for c in token): i for token, i in told["model"]["vocab"].items() if token not in self.special}
            self.bpe = tiktoken.Encoding("pieces", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        if self.bpe is None or any(x in text for x in self.special):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        head, *tail = text.split(" ")
        got = list(map(self.rest.get, tail))
        if None in got:
            if len(self.rest) > CACHE_ENTRIES:
                self.rest.clear()
            for k, x in enumerate(got):
                if x is None and (x := self.rest.get(tail[k])) is None:
                    if not tail[k] or tail[k][0].isspace():
                        return self.plain(text)
                    x = self.rest[tail[k]] = self.plain(" " + tail[k])
                got[k] = x
        return self.plain(head) + b"".join(got)

    def plain(self, text: str) -> bytes:
        return np.array(self.bpe.encode_ordinary(text), "<u4").tobytes()


def byte_level(told: dict) -> bool:
    """Whether a tokenizer file describes plain byte-level BPE: the published pattern, nothing changed before it, merges in the order of ids."""
    model, pre = told.get("model") or {}, told.get("pre_tokenizer") or {}
    if told.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or told.get("truncation") or told.get("padding"):
        return False
    if model.get("type") != "BPE" or any(model.get(x) for x in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
        return False
    added = {x["content"] for x in told.get("added_tokens") or ()}
    chars, vocab = set(_byte_chars().values()), model["vocab"]
    ids = [vocab.get("".join(m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
    return None not in ids and ids == sorted(ids) and chars <= vocab.keys() and all(set(t) <= chars for t in vocab.keys() - added) and len(vocab.keys() - added) == len(ids) + len(chars)


def _byte_chars() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(kept)]
    return {b: chr(b) for b in kept} | {b: chr(256 + k) for k, b in enumerate(rest)}


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: all full but the first."""
    k = -(-n // capacity)
    first = n - (k - 1) * capacity
    return [(0, first)] + [(first + j * capacity, capacity) for j in range(k - 1)]


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int = 0, ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids, if asked for) of every document, plus the task
    that made the piece and the piece's rank among that task's pieces of its length.

    A null text is empty; every document has at least the end id.  doc_id may be null or repeated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, seen, tail = encoder(tokenizer), TaskContext.get().partitionId(), Counter(), np.array([end_id], "<u4").tobytes()
        for b in pieces(batches):
            out: list[tuple] = []
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                raw = enc(text or "") + tail
                for k, (start, length) in enumerate(cut(len(raw) // 4, capacity)):
                    own = raw[4 * start : 4 * (start + length)]
                    out.append((doc, k, start, length, zlib.crc32(own), part, seen[length], *([np.frombuffer(own, "<u4").astype(np.int32)] if ids else [])))
                    seen[length] += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"] + ["ids"] * ids
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()] + [pa.list_(pa.int32())] * ids
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, part long, nth long" + ", ids array<int>" * ids
    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(run, schema)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Where pieces of each length go: (length, first rank, first bin, pieces per bin, offset, pieces).

    The r-th piece after the first rank goes to bin first + r // per, at offset + (r % per) * length."""
    left = {s: c for s, c in counts.items() if c > 0}
    given = dict.fromkeys(left, 0)
    gaps: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # by gap: ranges (first bin, bins)
    out, bins = [], 0

    def place(s: int, first: int, per: int, offset: int, n: int) -> None:
        out.append((s, given[s], first, per, offset, n))
        given[s] += n
        left[s] -= n

    for s in sorted((s for s in left if 3 * s > capacity), reverse=True):
        while left[s]:
            t = next((t for t in range(min(s, capacity - s), capacity // 3, -1) if left.get(t, 0) > (t == s)), 0)
            n = left[s] // 2 if t == s else min(left[s], left[t]) if t else left[s]
            place(s, bins, 1, 0, n)
            if t:
                place(t, bins, 1, s, n)
            gaps[capacity - s - t].append((bins, n))
            bins += n
    for s in sorted((s for s in left if 3 * s <= capacity), reverse=True):
        while left[s]:
            g = next((g for g in range(s, capacity + 1) if gaps[g]), 0)
            if not g:
                n = -(-left[s] // (capacity // s))
                gaps[capacity].append((bins, n))
                bins += n
                g = capacity
            first, n = gaps[g].pop()
            per = min(g // s, left[s])
            full = min(n, left[s] // per)
            place(s, first, per, capacity - g, full * per)
            gaps[g - per * s].append((first, full))
            if n > full:
                gaps[g].append((first + full, n - full))
    return out


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, ids: bool = False) -> DataFrame:
    """Packs all documents (doc_id, text; other columns are ignored) into sequences of at most `capacity` tokens.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids, if asked for), a row per piece.
    Null and empty texts are the end id alone; very long ones are cut into pieces; pieces of equal length take places in any order; repeated rows are packed as often
    as they come, a null doc_id stays null; an empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    made = scratch.save(token_pieces(docs, tokenizer, capacity, end_id, ids), "pieces")
    per_task = made.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = scratch.save(per_task.select("length", "part", "n", (F.sum("n").over(W.partitionBy("length").orderBy("part")) - F.col("n")).alias("base")), "counts")
    counts = {int(r[0]): int(r[1]) for r in before.groupBy("length").agg(F.sum("n")).collect()}  # a row per length: at most `capacity`
    rows = sorted(plan(counts, capacity))
    table = np.array(rows or [(0,) * 6], np.int64)
    sent = spark.sparkContext.broadcast(table)  # a few rows per length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = sent.value
        key = t[:, 0] * (1 << 48) + t[:, 1]
        for b in batches:
            length, rank = (b.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            p = t[np.searchsorted(key, length * (1 << 48) + rank, "right") - 1]
            r = rank - p[:, 1]
            place = {"sequence_id": p[:, 2] + r // np.maximum(p[:, 3], 1), "offset": p[:, 4] + r % np.maximum(p[:, 3], 1) * length}
            yield pa.RecordBatch.from_arrays([pa.array(place[c]) if c in place else b.column(c) for c in names], names)

    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] + ["ids"] * ids
    # a row per length and task: it grows with the table, so it isn't broadcast
    ranked = made.join(before.select("length", "part", "base").hint("shuffle_merge"), ["length", "part"]).withColumn("rank", F.col("nth") + F.col("base"))
    return ranked.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long" + ", ids array<int>" * ids)
