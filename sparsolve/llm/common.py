"""Plumbing shared by the training-data operators: tables, scratch space, words, hashes, components."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Entries after which a worker's word cache starts anew.
CACHE_ENTRIES = 200_000
#: Rows that a Python loop looks at together, whatever the size of Arrow's batches.
SLICE_ROWS = 256
#: Bytes of an Arrow batch between Spark and Python at most; Spark's own bound lets a batch of long texts take 64 MB or more in either, several times over.
BATCH_BYTES = 4 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset on one machine (tests), a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = getattr(shared_dir, "own", None)
    if own is None:
        own = shared_dir.own = tempfile.mkdtemp(prefix="sparsolve-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
    return f"file://{own}"


def delete(spark: SparkSession, path: str) -> None:
    """Removes a folder through Spark's own file systems, so any store works."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def small_batches(spark: SparkSession) -> None:
    """Bounds Arrow's batches by bytes, if they aren't bounded more narrowly; results don't depend on it."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch()) <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


class Scratch:
    """Tables written to the shared folder: they cut lineage and outlive lost executors."""

    def __init__(self, spark: SparkSession, tag: str):
        small_batches(spark)
        self.spark, self.root = spark, f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
        self.n = 0

    def save(self, df: DataFrame, name: str = "t") -> DataFrame:
        self.n += 1
        path = f"{self.root}/{name}-{self.n}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        for f in frames:
            delete(self.spark, f._scratch_path)

    def sweep(self) -> None:
        """Lets Spark delete the shuffle files of tables that are written and referred to no more: its cleaner waits for a collection in the driver."""
        gc.collect()
        self.spark._jvm.System.gc()


def pieces(batches: Iterable[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for k in range(0, b.num_rows, rows):
            yield b.slice(k, rows)


def utf8(column: pa.Array) -> list[bytes]:
    """The column's texts as bytes; null: empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


#: Everything below 0x80 that is no ASCII letter or digit becomes a space, A-Z become a-z.
_WORDS = bytes(c if c >= 128 or chr(c).isalnum() and not 65 <= c <= 90 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def plain_words(text: bytes) -> list[bytes]:
    """Lower-cased runs of ASCII letters, digits and whatever lies outside ASCII."""
    return text.translate(_WORDS).split()


def spaced_words(text: bytes) -> list[bytes]:
    """Lower-cased (A-Z) runs between ASCII white space."""
    return text.lower().split()


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_hashes = _WordHashes()
_P = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit hashes; a bijection."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash at each start of k consecutive words; of fewer words, one for the whole sequence."""
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    width = min(n, k)
    h = np.full(n - width + 1, width, np.uint64)
    for j in range(width):
        h = h * _P + words[j : n - width + 1 + j]
    return mix(h)


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def connected(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """Components of the links (u, v) of longs: one row (id, root) per linked id, root the least id reachable.

    Large and small stars in turn until nothing changes.  Each round's links are a written table;
    joins on a hub's key are plain equi-joins, which adaptive execution may split.
    """

    def shape(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    e = scratch.save(edges.where("u <> v").selectExpr("greatest(u, v) u", "least(u, v) v").distinct(), "links")
    was = shape(e)
    while was[0]:
        both = e.unionByName(e.selectExpr("v u", "u v"))
        near = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(near, "u").selectExpr("v u", "m v")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").selectExpr("v u", "m v").unionByName(low.selectExpr("u", "m v"))
        new = scratch.save(small.selectExpr("greatest(u, v) u", "least(u, v) v").distinct(), "links")
        scratch.drop(e)
        now, e = shape(new), new
        if now == was:
            break
        was = now
    return e.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "id").unionByName(e.selectExpr("v id", "v root").distinct())


def added_up(partial: DataFrame, width: int, chunk: int, how: np.ufunc = np.add) -> np.ndarray:
    """The sum of the tasks' arrays of longs, which come as rows (chunk int, counts binary) of `chunk` longs each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for k, raw in zip(b.column("chunk").to_pylist(), b.column("counts").to_pylist(), strict=True):
                total[k] = how(total.get(k, 0), np.frombuffer(raw, np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["chunk", "counts"])

    out = np.zeros(width, np.int64)
    for r in partial.repartition(16, "chunk").mapInArrow(run, "chunk int, counts binary").collect():  # width longs
        out[r["chunk"] * chunk : (r["chunk"] + 1) * chunk] = np.frombuffer(r["counts"], np.int64)
    return out


#: Bits of the filters that spare most rows another look; false hits cost time only.
FILTER_BITS = 23
_FILTER_CHUNK = 4096


def _places(ids: np.ndarray, bits: int) -> np.ndarray:
    return mix(np.ascontiguousarray(ids).astype(np.int64, copy=False).view(np.uint64)) >> np.uint64(64 - bits)


def mark(words: np.ndarray, ids: np.ndarray) -> None:
    """Notes the ids (longs) in a filter of 64-bit words."""
    at = np.unique(_places(ids, int(len(words) * 64).bit_length() - 1))
    if len(at):
        word = (at >> np.uint64(6)).astype(np.int64)
        first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        words[word[first]] |= np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), first)


def spotted(words: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Which of the ids may have been noted."""
    at = _places(ids, int(len(words) * 64).bit_length() - 1)
    return (words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def spare(names: Iterable[str], wish: str) -> str:
    """A column name like `wish` that none of the names is equal to, in whatever case."""
    taken = {n.lower() for n in names}
    while wish.lower() in taken:
        wish += "_"
    return wish


def filter_rows(words: np.ndarray) -> tuple[list[int], list[bytes]]:
    """A task's filter as the rows that `filter_sum` takes."""
    used = [c for c in range(len(words) // _FILTER_CHUNK) if words[c * _FILTER_CHUNK : (c + 1) * _FILTER_CHUNK].any()]
    return used, [words[c * _FILTER_CHUNK : (c + 1) * _FILTER_CHUNK].tobytes() for c in used]


def filter_sum(partial: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """The tasks' filters (chunk, counts) as one, of 2 ** bits bits."""
    return added_up(partial, (1 << bits) // 64, _FILTER_CHUNK, np.bitwise_or).view(np.uint64)


def seen_bits(ids: DataFrame, column: str, bits: int = FILTER_BITS) -> np.ndarray:
    """A filter of fixed size in which the ids of the table are noted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = np.zeros((1 << bits) // 64, np.uint64)
        for b in batches:
            mark(words, b.column(column).to_numpy())
        chunks, counts = filter_rows(words)
        yield pa.RecordBatch.from_arrays([pa.array(chunks, pa.int32()), pa.array(counts, pa.binary())], ["chunk", "counts"])

    return filter_sum(ids.select(column).mapInArrow(run, "chunk int, counts binary"), bits)
