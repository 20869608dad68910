"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

A document that holds at least t of an item's n shingles misses at most floor((1 - t) n) of them, so it holds one of any
floor((1 - t) n) + 1.  The item's sketch is that many of its smallest hashes.  Items are partitioned by size; a partition's
sketches reach up to some hash, and a document's hashes up to there are its sketch for this partition, of the
rate at which the partition samples hash space, however long the document is.  Shared sketch hashes give
candidates and miss none; candidates are then counted exactly over all shingles of item and document.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, plain_words, shingle_hashes, utf8, word_hashes

#: Code points of item texts that are sent to all tasks at a time; more items are looked up block after block.
BLOCK_CHARS = 8_000_000


class Items:
    """A block of benchmark items as an index of sketches by size partition."""

    def __init__(self, texts: list[tuple[int, bytes]], k: int, threshold: float):
        self.k, self.threshold, self.ids, self.sets, sizes = k, threshold, [], [], {}
        for item, text in texts:
            h = np.unique(shingle_hashes(word_hashes(plain_words(text)), k))
            if len(h):
                sizes.setdefault(len(h).bit_length(), []).append(len(self.ids))
                self.ids.append(item)
                self.sets.append(h)
        self.partitions = []
        for own in sizes.values():
            sketches = [self.sets[n][: len(self.sets[n]) - self.needed(n) + 1] for n in own]
            hashes, of = np.concatenate(sketches), np.repeat(own, [len(s) for s in sketches])
            order = np.argsort(hashes, kind="stable")
            self.partitions.append((hashes[order], of[order], hashes.max()))

    def needed(self, n: int) -> int:
        return int(np.ceil(self.threshold * len(self.sets[n]) - 1e-9))

    def __call__(self, texts: list[bytes]) -> list[tuple[int, int, float]]:
        """(text, item, containment) where it reaches the threshold."""
        each = [shingle_hashes(word_hashes(plain_words(t)), self.k) for t in texts]
        h, of = np.concatenate([*each, np.empty(0, np.uint64)]), np.repeat(np.arange(len(each)), [len(x) for x in each])
        pairs: set[tuple[int, int]] = set()
        for hashes, items, top in self.partitions:
            low = np.flatnonzero(h <= top)
            left, right = np.searchsorted(hashes, h[low], "left"), np.searchsorted(hashes, h[low], "right")
            for p in np.flatnonzero(right > left):
                pairs.update((int(of[low[p]]), int(n)) for n in items[left[p] : right[p]])
        out, held = [], {}
        for d, n in sorted(pairs):
            if d not in held:
                held = {d: np.unique(each[d])}
            share = np.isin(self.sets[n], held[d], assume_unique=True).sum()
            if share >= self.needed(n):
                out.append((d, self.ids[n], share / len(self.sets[n])))
        return out


def contaminated(docs: DataFrame, benchmark: DataFrame, k: int = 5, threshold: float = 0.8) -> DataFrame:
    """Pairs (doc_id, item_id, containment) in which a document (doc_id, text) holds at least `threshold` of the distinct
    k-word shingles of a benchmark item (item_id, text).

    Words are lower-cased (A-Z) runs of letters, digits and what lies outside ASCII.  Fewer than k words: the whole sequence as one
    shingle, which only a text of just these words has.  Null and empty texts meet nothing.  Null doc_ids or item_ids give pairs with nulls.
    Repeated documents or items: each pair once.  Empty tables give no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    asked = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null").distinct()
    chars = asked.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks, found, schema = int(chars // BLOCK_CHARS) + 1, [], "doc_id long, item_id long, containment double"
    for n in range(blocks):
        own = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == n).collect()  # BLOCK_CHARS on average
        sent = spark.sparkContext.broadcast(Items(sorted(((r["item_id"], r["text"].encode()) for r in own), key=str), k, threshold))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for b in pieces(batches):
                got = sent.value(utf8(b.column("text")))
                ids = b.column("doc_id").to_pylist()
                yield pa.RecordBatch.from_arrays([pa.array([ids[g[0]] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.int64()), pa.array([g[2] for g in got], pa.float64())], ["doc_id", "item_id", "containment"])

        found.append(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema))
    return reduce(DataFrame.unionByName, found).groupBy("doc_id", "item_id").agg(F.max("containment").alias("containment"))
