"""N-gram Jaccard join: which documents hang together by links of a given similarity.  Exact; no cap on anything.

Documents with equal shingle sets are one node.  The join of different sets is a size-aware heavy-light join.  All tokens have one
global order, rare ones first (by a fixed-size sketch of document frequencies, then by hash).  Two sets of the wanted
similarity share a token in their prefixes, and two tokens in prefixes one longer.  So light (small) sets enumerate the
2-subsets of their longer prefix, and heavy (large) ones scan the inverted lists of their prefix tokens; light sets near the
boundary are also put on the lists, for their heavy partners.  The boundary is where enumerating stops being cheaper.

Candidates become components as `linking` has it.  A pair is dropped if histograms of its hashed shingles show that too few can be
shared; the others are counted exactly.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, added_up, mix, pieces, seen_bits, shingle_hashes, signed, spaced_words, spotted, utf8, word_hashes
from .linking import Linker

#: Counters of the document-frequency sketch, and the chunks in which they travel.
SKETCH_BITS = 20
_CHUNK = 1024
#: Buckets of a set's histogram.
BUCKETS = 128
#: A key gets another salt for each so many nodes.
SALT = 2048
#: Sets above this size are never light.
LIGHT_MOST = 64


def needed(n: int | np.ndarray, num: int, den: int):
    """Least overlap of a set of n with any partner: ceil(n * num / den)."""
    return -(-n * num // den)


def boundary(sketch: np.ndarray, num: int, den: int) -> int:
    """The largest size at which enumerating 2-subsets costs no more rows than scanning lists.

    A list's expected length comes from the sketch, without the few most frequent counters, which the order keeps out of prefixes."""
    c = np.sort(sketch)[: max(1, int(len(sketch) * 0.999))].astype(float)
    others = max(0.5, (c * c).sum() / max(1.0, c.sum()) - c.sum() / len(c) - 1.0)
    best = 0
    for n in range(2, LIGHT_MOST + 1):
        p = n - needed(n, num, den) + 1
        if (p + 1) * p / 2 <= p * (1 + others):
            best = n
    return best


def keys_of(h: np.ndarray, df: np.ndarray, light: int, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """The keys under which a set (sorted hashes, estimated frequencies) looks for partners, and their estimated frequencies."""
    n = len(h)
    p = n - needed(n, num, den) + 1
    order = np.lexsort((h, df))[: p + 1]
    h, df = h[order], df[order]
    keys, freq = [], []
    if n <= light:
        a, b = np.triu_indices(len(h), 1)
        keys.append(mix(h[a] * np.uint64(0x9E3779B97F4A7C15) + h[b]))
        freq.append(np.minimum(df[a], df[b]))
    if n > light or needed(light + 1, num, den) <= n:
        keys.append(h[:p])
        freq.append(df[:p])
    return np.concatenate(keys), np.concatenate(freq)


def _set_digest(h: np.ndarray) -> tuple[int, int]:
    d = xxhash.xxh3_128_digest(h.tobytes())
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _bucket(h: np.ndarray) -> np.ndarray:
    return np.minimum(np.bincount((h >> np.uint64(20)).astype(np.int64) % BUCKETS, minlength=BUCKETS), 65535).astype(np.uint16)


@dataclass(frozen=True)
class Sets:
    """Texts to their sorted sets of hashed shingles."""

    k: int
    words: Callable[[bytes], list[bytes]]

    def __call__(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        for t in texts:
            yield np.unique(shingle_hashes(word_hashes(self.words(t)), self.k))


@dataclass(frozen=True)
class Enough:
    """Whether histograms allow enough shared shingles: the sum of the buckets' lesser counts is at least what is shared."""

    num: int
    den: int

    def __call__(self, u: np.ndarray, un: int, v: np.ndarray, vn: np.ndarray) -> np.ndarray:
        return (self.num + self.den) * np.minimum(u, v).sum(1, dtype=np.int64) >= self.num * (un + vn)


class JaccardJoin:
    def __init__(self, docs: DataFrame, k: int, num: int, den: int, words: Callable[[bytes], list[bytes]] = spaced_words):
        if not den >= num > den / 2:
            raise ValueError("the similarity lies above one half")
        self.spark, self.num, self.den, self.sets = docs.sparkSession, num, den, Sets(k, words)
        self.docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        self.scratch = Scratch(self.spark, "jaccard")

    def first_look(self) -> tuple[DataFrame, np.ndarray]:
        """(doc_id, n, a, b) with the set's digest a, b; and the sketch."""
        sets, width = self.sets, 1 << SKETCH_BITS

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sketch = np.zeros(width, np.int64)
            for b in pieces(batches):
                rows, seen = [], []
                for h in sets(utf8(b.column("text"))):
                    rows.append((len(h), *_set_digest(h)))
                    seen.append(h)
                np.add.at(sketch, (np.concatenate(seen) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), 1)
                n = len(rows)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, pa.int64()) for c in zip(*rows, strict=True)), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names)
            chunks = [c for c in range(width // _CHUNK) if sketch[c * _CHUNK : (c + 1) * _CHUNK].any()]
            none = [pa.nulls(len(chunks), pa.int64())] * 4
            yield pa.RecordBatch.from_arrays([*none, pa.array(chunks, pa.int32()), pa.array([sketch[c * _CHUNK : (c + 1) * _CHUNK].tobytes() for c in chunks], pa.binary())], names)

        names = ["doc_id", "n", "a", "b", "chunk", "counts"]
        both = self.scratch.save(self.docs.mapInArrow(run, "doc_id long, n long, a long, b long, chunk int, counts binary"), "look")
        sketch = added_up(both.where("chunk is not null").select("chunk", "counts"), width, _CHUNK)
        return both.where("chunk is null").select("doc_id", "n", "a", "b"), sketch

    def second_look(self, heads: DataFrame, sketch: np.ndarray) -> DataFrame:
        """Nodes (id, n, w, hist, keys, salts, split): a document for each different set; w: how common its shingles are."""
        sent = self.spark.sparkContext.broadcast(np.minimum(sketch, 2**32 - 1).astype(np.uint32))  # 2 ** SKETCH_BITS counters
        sets, num, den, light = self.sets, self.num, self.den, boundary(sketch, self.num, self.den)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counters, seen = sent.value, set()
            for b in pieces(batches):
                out = []
                for doc, h in zip(b.column("doc_id").to_pylist(), sets(utf8(b.column("text"))), strict=True):
                    if not len(h) or doc is None:
                        continue
                    df = counters[(h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
                    keys, freq = keys_of(h, df, light, num, den)
                    parts = freq.astype(np.int64) // SALT + 1
                    out.append((doc, len(h), float(np.log(df).mean()), *_set_digest(h), _bucket(h).tobytes(), signed(keys), doc % parts, parts > 1))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

        names = ["id", "n", "w", "a", "b", "hist", "keys", "salts", "split"]
        types = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()] + [pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.bool_())]
        found = self.docs.mapInArrow(run, "id long, n long, w double, a long, b long, hist binary, keys array<long>, salts array<long>, split array<boolean>")
        return self.scratch.save(found.join(heads.select(F.col("rep").alias("id"), "a", "b"), ["id", "a", "b"]).select("id", "n", "w", "hist", "keys", "salts", "split"), "nodes")

    def links(self, pairs: DataFrame, nodes: DataFrame, heads: DataFrame) -> DataFrame | None:
        """Those of the pairs that are similar enough."""
        num, den, enough = self.num, self.den, Enough(self.num, self.den)
        side = lambda x: nodes.selectExpr(f"id {x}", f"n {x}n", f"hist {x}h")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                hist = [np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint16).reshape(-1, BUCKETS) for c in ("uh", "vh")]
                ok = enough(hist[0], b.column("un").to_numpy(), hist[1], b.column("vn").to_numpy())
                yield pa.RecordBatch.from_arrays([b.column(c) for c in ("u", "v", "un", "vn")], ["u", "v", "un", "vn"]).filter(pa.array(ok))

        near = pairs.join(side("u"), "u").join(side("v"), "v").select("u", "v", "un", "vn", "uh", "vh").mapInArrow(run, "u long, v long, un long, vn long")
        near = self.scratch.save(near.distinct(), "near")
        ids = self.scratch.save(near.selectExpr("u id").union(near.selectExpr("v id")).distinct(), "ids")
        if ids.isEmpty():
            return None
        sets = self.third_look(ids, heads)
        both = near.join(sets.selectExpr("id u", "set us"), "u").join(sets.selectExpr("id v", "set vs"), "v")
        shared = F.size(F.array_intersect("us", "vs"))
        return self.scratch.save(both.where((num + den) * shared.cast("long") >= num * (F.size("us") + F.size("vs"))).select("u", "v").distinct(), "links")

    def third_look(self, ids: DataFrame, heads: DataFrame) -> DataFrame:
        """(id, set) of the given nodes."""
        sent, sets = self.spark.sparkContext.broadcast(seen_bits(ids, "id")), self.sets  # 2 ** FILTER_BITS bits

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bits = sent.value
            for b in pieces(batches):
                b = b.filter(b.column("doc_id").is_valid())
                b = b.filter(pa.array(spotted(bits, b.column("doc_id").to_numpy())))
                out = [(doc, *_set_digest(h), signed(h)) for doc, h in zip(b.column("doc_id").to_pylist(), sets(utf8(b.column("text"))), strict=True)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.int64()] * 3 + [pa.list_(pa.int64())], strict=True)], ["id", "a", "b", "set"])

        found = self.docs.mapInArrow(run, "id long, a long, b long, set array<long>")
        wanted = heads.select(F.col("rep").alias("id"), "a", "b").join(ids, "id", "left_semi")
        return self.scratch.save(found.join(wanted, ["id", "a", "b"]).select("id", "set"), "sets")

    def components(self) -> DataFrame:
        looked, sketch = self.first_look()
        heads = self.scratch.save(looked.where("n > 0").groupBy("a", "b").agg(F.min("doc_id").alias("rep")), "heads")
        nodes = self.second_look(heads, sketch)
        rows = nodes.select("id", "n", "w", F.expr("inline(arrays_zip(keys, salts, split))")).toDF("id", "n", "w", "key", "salt", "split")
        fits = lambda a, b: F.expr(f"{self.den} * least({a}, {b}) >= {self.num} * greatest({a}, {b})")
        roots = Linker(self.scratch, fits, lambda pairs: self.links(pairs, nodes, heads), lambda ids: nodes.selectExpr("id", "hist sig"), Enough(self.num, self.den)).roots(rows)
        out = looked.join(heads, ["a", "b"], "left").join(roots.withColumnRenamed("id", "rep"), "rep", "left")
        return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("root", "rep", "doc_id").alias("component_id"))


def jaccard_components(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, words: Callable[[bytes], list[bytes]] = spaced_words) -> DataFrame:
    """doc_id, n_shingles, component_id for each document (doc_id, text; other columns are ignored).

    Two documents link if den * intersection >= num * union of their sets of distinct k-word shingles; component_id is the smallest doc_id
    reachable by links.  Fewer than k words: the whole sequence as one shingle.  Null, empty and wordless texts link with nothing.
    Repeated rows come as often.  A row with a null doc_id links nothing, but takes the component of an equal set.
    Rows of one doc_id with different texts count as linked.  An empty table gives no rows.
    """
    return JaccardJoin(docs, k, num, den, words).components()
