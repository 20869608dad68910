"""Components of similar nodes from candidate keys, without making all pairs of a large group.

Nodes that may be similar share a key.  A key's list of up to `SHORT` nodes gives all its pairs.  A longer one gives a star: each
node with the list's hub, the one of the highest weight.  As only components are asked for, long lists then give pairs of nodes of
different components alone: stars around other hubs first.  Whatever is left is compared by signatures in blocks of bounded size, each
node outside a block's largest component with the nodes of others; only pairs that the signatures can't rule out become rows.  Keys that many
nodes share come with a salt; the hubs of a key's parts form a star of their own.  Every link is verified, and no pair that
could join two components goes unseen.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, connected

#: Lists of up to so many nodes give all their pairs.
SHORT = 12
#: Stars around other hubs before what is left is compared in blocks.
STARS = 1
#: Nodes of a block.
BLOCK = 4096

#: Nodes of a part of a key's list.
SALT = 2048

#: near(signature, size, signatures, sizes): which of the others may be similar; signatures as rows of uint16.
Near = Callable[[np.ndarray, int, np.ndarray, np.ndarray], np.ndarray]


def salted(rows: DataFrame) -> DataFrame:
    """(key, id, n) as (key, salt, split, id, n, w): lists of over SALT nodes in parts of about that size.

    The counts of the long lists are at most one row per SALT rows."""
    many = rows.groupBy("key").agg(F.count("*").alias("many")).where(F.col("many") > SALT)
    parts = F.coalesce(F.col("many") / SALT + 1, F.lit(1)).cast("long")
    return rows.join(many, "key", "left").select("key", F.pmod(F.xxhash64("id"), parts).alias("salt"), (parts > 1).alias("split"), "id", "n", F.lit(0.0).alias("w"))


class Linker:
    def __init__(self, scratch: Scratch, fits: Callable[[str, str], Column], verify: Callable[[DataFrame], DataFrame | None], signatures: Callable[[DataFrame], DataFrame], near: Near, ready: Callable[[DataFrame], None] = lambda ids: None, short: int | None = None):
        """short: lists of up to so many nodes give all their pairs; ready: told the ids of all nodes that may stand in pairs; fits: whether nodes of these sizes (columns) may be similar; verify: those of the pairs (u, v) that are, or None; signatures: (id, sig) of the nodes in a table of ids."""
        self.scratch, self.fits, self.verify, self.signatures, self.near, self.ready = scratch, fits, verify, signatures, near, ready
        self.short = SHORT if short is None else short

    def lists(self, rows: DataFrame) -> DataFrame:
        """Of (key, salt, split, id, n, w), those whose part of a key has several nodes, with its size and hub."""
        w = W.partitionBy("key", "salt")
        hub = F.max(F.struct("w", F.xxhash64("id").alias("r"), "id", "n")).over(w)
        found = rows.withColumn("size", F.count("*").over(w)).withColumn("h", hub).where("size > 1 or split")
        return self.scratch.save(found.selectExpr("key", "split", "salt", "id", "n", "size", "h.id hub", "h.n hub_n", "h.w hub_w"), "lists")

    def _pairs(self, rows: DataFrame) -> DataFrame:
        """Different pairs u < v of (x, xn, y, yn) whose sizes fit."""
        return rows.where("x <> y").where(self.fits("xn", "yn")).selectExpr("least(x, y) u", "greatest(x, y) v").distinct()

    def first_pairs(self, lists: DataFrame) -> DataFrame:
        star = lists.where(f"size > {self.short}").selectExpr("id x", "n xn", "hub y", "hub_n yn")
        hubs = lists.where("split").select("key", "hub", "hub_n", "hub_w").distinct()
        top = F.max(F.struct("hub_w", F.xxhash64("hub").alias("r"), F.col("hub").alias("id"), F.col("hub_n").alias("n"))).over(W.partitionBy("key"))
        over = hubs.withColumn("h", top).selectExpr("hub x", "hub_n xn", "h.id y", "h.n yn")
        # the pairs of a short list, made where the list is: at most `short` per row
        short = lists.where(f"size <= {self.short}").groupBy("key", "salt").agg(F.collect_list(F.struct("id", "n")).alias("l"))
        each = short.select("l", F.explode("l").alias("x")).select("x", F.explode("l").alias("y")).where("x.id < y.id").selectExpr("x.id x", "x.n xn", "y.id y", "y.n yn")
        return self._pairs(star.unionByName(over).unionByName(each))

    def later_pairs(self, lists: DataFrame, roots: DataFrame, turn: int) -> DataFrame | None:
        """Pairs of different components on long or split lists: stars for the first turns, all that are left at last; None if no list mixes components."""
        if turn == 1:
            self.open = lists.where(f"split or size > {self.short}")
        # lists of one component stay so: later turns look at those that were mixed
        long = self.open.select("key", "id", "n").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
        mixed = long.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("key")
        open_ = self.open = self.scratch.save(long.join(mixed, "key"), "open")
        if open_.isEmpty():
            return None
        if turn <= STARS:
            hub = open_.groupBy("key").agg(F.min(F.struct(F.xxhash64("id", F.lit(turn)).alias("r"), "id", "n", "root")).alias("h"))
            return self._pairs(open_.join(hub, "key").where("root <> h.root").selectExpr("id x", "n xn", "h.id y", "h.n yn"))
        return self._left(open_)

    def _left(self, open_: DataFrame) -> DataFrame:
        """Pairs of different components that the signatures can't rule out; of (key, id, n, root)."""
        near = self.near

        def run(table: pa.Table) -> pa.Table:
            t = table.combine_chunks()
            _, first = np.unique(t["id"].to_numpy(), return_index=True)
            t = t.take(first)
            ids, n, root, block, x, y = (t[c].to_numpy() for c in ("id", "n", "root", "block", "x", "y"))
            sig = np.frombuffer(b"".join(t["sig"].to_pylist()), np.uint16).reshape(len(ids), -1)
            names, count = np.unique(root, return_counts=True)
            out = [np.empty((0, 4), np.int64)]
            for u in np.flatnonzero(root != names[count.argmax()]):
                # two blocks: with the other one only; two nodes outside the largest component meet once
                other = (root != root[u]) & ((block != block[u]) | (x == y)) & ((root == names[count.argmax()]) | (ids > ids[u]))
                v = np.flatnonzero(other)
                v = v[near(sig[u], n[u], sig[v], n[v])]
                out.append(np.stack([np.full(len(v), ids[u]), np.full(len(v), n[u]), ids[v], n[v]], 1))
            found = np.concatenate(out)
            return pa.table({c: found[:, k] for k, c in enumerate(("x", "xn", "y", "yn"))})

        size = F.count("*").over(W.partitionBy("key"))
        dealt = open_.distinct().withColumn("blocks", F.ceil(size / BLOCK)).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
        pairs = dealt.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).selectExpr("key", "id", "n", "root", "block", "least(block, k) x", "greatest(block, k) y")
        signed_ = pairs.join(self.signatures(open_.select("id").distinct()), "id").select("key", "id", "n", "root", "block", "x", "y", "sig")
        found = signed_.groupBy("key", "x", "y").applyInArrow(run, "x long, xn long, y long, yn long")
        return self._pairs(found)

    def roots(self, rows: DataFrame, more: DataFrame | None = None) -> DataFrame:
        """(id, root) of all nodes that have a link, root being the least id of the component; rows: (key, salt, split, id, n, w); more: further pairs (u, v)."""
        lists = self.lists(rows)
        ids, first = lists.select("id"), self.first_pairs(lists)
        if more is not None:
            ids, first = ids.union(more.select("u")).union(more.select("v")), first.union(more.select("u", "v")).distinct()
        self.ready(ids.distinct())
        links = self.verify(first)
        roots = connected(self.scratch, links if links is not None else self.scratch.spark.createDataFrame([], "u long, v long"))
        for turn in range(1, STARS + 2):
            pairs = self.later_pairs(lists, roots, turn)
            if pairs is None:
                break
            new = self.verify(pairs)
            if new is not None:
                roots = connected(self.scratch, roots.selectExpr("id u", "root v").unionByName(new))
        self.scratch.drop(lists)
        return roots
