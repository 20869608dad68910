"""Exact top-k inner-product search by exhaustive term-at-a-time accumulation.

Queries come in blocks of bounded size; each is sent to all tasks, which read every row once.  A task holds
a dense array of scores (some queries x rows of a batch, small enough for the processor's cache) and goes through the terms: of each term,
the postings of the rows, weighted with the weights of the queries that have it, are scattered into the scores.  Each task keeps k per query,
by partition selection; the tasks' lists are merged at last.

Scores are exact: sums that stay below 2**53 are held as doubles, those below 2**63 as longs; greater ones can't be returned and raise an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows whose scores are held at a time.
BATCH_ROWS = 4096
#: Rows and weights of a query block (hashed, so on average): what is sent to all tasks at once.
BLOCK_QUERIES = 2048
BLOCK_WEIGHTS = 4_000_000
#: Queries whose scores with a batch are held together.
CHUNK_QUERIES = 64
_NONE = np.int64(-(1 << 62))


def whole_weights(column: pa.ListArray, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Which rows take part, and their floor(scale * x) as a dense matrix; shorter rows end in zeros.

    A row that is null, or holds a null or non-finite component, takes no part."""
    flat = column.flatten()
    size = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    x = flat.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), int(size.max(initial=0))))
    row = np.repeat(np.arange(len(column)), size)
    out[row, np.arange(len(x)) - np.repeat(np.cumsum(size) - size, size)] = x
    ok = column.is_valid().to_numpy(zero_copy_only=False) & np.isfinite(out).all(1)
    with np.errstate(over="ignore", invalid="ignore"):
        return ok, np.floor(scale * out)


def exact_type(queries: np.ndarray, rows: np.ndarray) -> type:
    """The numbers that hold every score and every sum on the way to it."""
    terms = min(queries.shape[1], rows.shape[1])
    if not len(queries) or not len(rows) or not terms:
        return np.float64
    most = float((np.abs(queries[:, :terms]) @ np.abs(rows[:, :terms]).max(0)).max()) * (1 + 1e-9)
    if most < 2.0**53:
        return np.float64
    if most < 2.0**62:
        return np.int64
    raise OverflowError(f"inner products of up to {most:.3g} don't fit a long")


def accumulate(queries: np.ndarray, rows: np.ndarray, kind: type = np.float64) -> np.ndarray:
    """Scores of all queries with all rows, term after term; weights are whole numbers, `kind` holds all sums."""
    terms = min(queries.shape[1], rows.shape[1])
    by_query, by_row = queries[:, :terms].T.astype(kind), rows[:, :terms].T.astype(kind)
    scores = np.zeros((len(queries), len(rows)), kind)
    for asking, held in zip(by_query, by_row, strict=True):
        asks, postings = np.flatnonzero(asking), np.flatnonzero(held)
        if len(asks) == len(scores) and len(postings) == scores.shape[1]:  # everywhere: the same scatter without an index
            scores += np.multiply.outer(asking, held)
        elif len(asks) and len(postings):
            scores[np.ix_(asks, postings)] += np.multiply.outer(asking[asks], held[postings])
    return scores


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest distinct ids of each line, ties to smaller ids; unused places score _NONE."""
    order = np.lexsort((ids, -scores), axis=1)
    ids, scores = np.take_along_axis(ids, order, 1), np.take_along_axis(scores, order, 1)
    again = np.zeros(ids.shape, bool)
    for j in range(1, ids.shape[1]):
        again[:, j] = (ids[:, :j] == ids[:, j : j + 1]).any(1)
    scores = np.where(again, _NONE, scores)
    order = np.argsort(again, axis=1, kind="stable")[:, :k]
    return np.take_along_axis(ids, order, 1), np.take_along_axis(scores, order, 1)


def select(queries: np.ndarray, own: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best rows of one batch (distinct ids) for each query, its own id left out."""
    order = np.argsort(ids, kind="stable")
    ids, rows = ids[order], rows[order]
    n, kept = len(ids), min(k + 1, len(ids))  # one more, for the query's own
    got, found, kind = [], [], exact_type(queries, rows)
    for start in range(0, len(queries), CHUNK_QUERIES):
        scores = accumulate(queries[start : start + CHUNK_QUERIES], rows, kind)
        least = np.partition(scores, n - kept, axis=1)[:, n - kept, None]
        above, level = scores > least, scores == least
        level &= np.cumsum(level, axis=1, dtype=np.int32) <= kept - above.sum(1, keepdims=True)  # of equal scores the smaller ids
        at = np.nonzero(above | level)[1].reshape(len(scores), kept)
        got.append(ids[at])
        found.append(np.take_along_axis(scores, at, 1).astype(np.int64))
    ids, scores = (np.concatenate(x) if x else np.zeros((0, kept), np.int64) for x in (got, found))
    return ids, np.where(ids == own[:, None], _NONE, scores)


def topk(rows: DataFrame, queries: DataFrame, k: int = 5, scale: float = 256.0, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k rows of highest inner product for each query: query_id, rank (from 1), vec_id, score.

    `rows` and `queries` have an id and an array of numbers; weights are floor(scale * x), scores exact; if one may reach 2**62 in size, an OverflowError is raised.  Vectors that are null, or hold nulls or
    non-finite components, take no part, nor do rows with a null id; shorter vectors are filled up with zeros.
    A query doesn't find its own id.  Repeated ids: an id comes once in a list, with its highest score; of repeated queries
    the greatest vector asks.  Fewer than k rows: all of them.  Empty tables give no rows.  Other columns are ignored.
    """
    spark = rows.sparkSession
    asked = queries.select(F.col(id).cast("long").alias("query_id"), F.col(vector).alias("v")).where("query_id is not null and v is not null").groupBy("query_id").agg(F.max("v").alias("v"))
    width = rows.agg(F.max(F.size(vector))).first()[0] or 1
    size = max(1, min(BLOCK_QUERIES, BLOCK_WEIGHTS // max(1, width)))
    blocks = -(-asked.count() // size)
    schema = "query_id long, vec_id long, score long"
    parts = []
    for n in range(blocks):
        table = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == n).toArrow()
        ok, weights = whole_weights(table["v"].combine_chunks(), scale)
        if not ok.any():
            continue
        sent = spark.sparkContext.broadcast((table["query_id"].to_numpy()[ok], weights[ok]))  # BLOCK_QUERIES rows on average

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            own, asks = sent.value
            ids, scores = np.zeros((len(own), 0), np.int64), np.zeros((len(own), 0), np.int64)
            for whole in batches:
                for start in range(0, whole.num_rows, BATCH_ROWS):
                    b = whole.slice(start, BATCH_ROWS)
                    ok, weights = whole_weights(b.column("v"), scale)
                    ok &= b.column("id").is_valid().to_numpy(zero_copy_only=False)
                    vec, weights = b.column("id").fill_null(0).to_numpy()[ok], weights[ok]
                    while len(vec):
                        _, first = np.unique(vec, return_index=True)  # a batch may repeat ids
                        new = select(asks, own, weights[first], vec[first], k)
                        ids, scores = best(np.hstack([ids, new[0]]), np.hstack([scores, new[1]]), k)
                        rest = np.setdiff1d(np.arange(len(vec)), first)
                        vec, weights = vec[rest], weights[rest]
            q, at = np.nonzero(scores > _NONE)
            yield pa.RecordBatch.from_arrays([pa.array(own[q]), pa.array(ids[q, at]), pa.array(scores[q, at])], ["query_id", "vec_id", "score"])

        parts.append(rows.select(F.col(id).cast("long").alias("id"), F.col(vector).alias("v")).mapInArrow(run, schema))
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    found = reduce(DataFrame.unionByName, parts).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
