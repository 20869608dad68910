"""Line dedup by a segment-partition edit join.

Lines of at least `FUZZY` code points that are within `EDITS` edits of each other are duplicates, shorter ones if they are equal.
Of two lines within t edits, the shorter one cut into t + 1 even segments has a segment that the longer one holds, at a
place that the lengths and the segment's number narrow down.  So each line indexes its segments under (number, length,
hash), and probes, for each length from its own down to t less, the substrings at the few places where that
segment may stand.  Filters of fixed size spare most probes (no such segment) and most segments (neither probed nor another line's too).
Shared keys give candidates as `linking` has it; a banded bit-parallel edit distance decides, after equal ends are cut off.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, added_up, mix, pieces, seen_bits, signed, spotted
from .linking import Linker, salted

EDITS = 2
#: Code points from which lines may differ by edits.
FUZZY = 24
#: Bits of each filter of indexed segments, and of the one of probed segments.
SEGMENT_BITS = 26
PROBE_BITS = 25
#: Words of a filter that travel together.
_CHUNK = 4096
#: Buckets of a line's histogram of code points.
BUCKETS = 128
#: Entries after which a task's memory of lines that it has looked at starts anew.
SEEN = 400_000
_LAST = (1 << 63) - 1


def line_id(line: str) -> int:
    return xxhash.xxh3_64_intdigest(line) - (1 << 63)


def segments(n: int, t: int) -> list[tuple[int, int]]:
    """(start, length) of t + 1 even segments of n code points, the shorter ones first."""
    base, longer = divmod(n, t + 1)
    out, at = [], 0
    for k in range(t + 1):
        size = base + (k > t - longer)
        out.append((at, size))
        at += size
    return out


_BASE = 0x9E3779B97F4A7C15
_powers = np.ones((2, 1), np.uint64)


def _power_table(n: int) -> np.ndarray:
    """The first n powers of _BASE modulo 2 ** 64, and of its inverse."""
    global _powers
    if _powers.shape[1] < n:
        steps = np.array([[_BASE], [pow(_BASE, -1, 1 << 64)]], np.uint64)
        _powers = np.multiply.accumulate(np.hstack([np.ones((2, 1), np.uint64), np.repeat(steps, 2 * n, 1)]), axis=1)
    return _powers


def places(t: int) -> list[tuple[int, int, int]]:
    """(delta, number, shift): a segment of that number, of a line shorter by delta, may stand so far from its own place in this line; a line's own segments left out."""
    return [(delta, k, q) for delta in range(t + 1) for k in range(t + 1) for q in range(max(-k, delta - t + k), min(k, delta + t - k) + 1) if delta or q]


def line_keys(own: list[str], t: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the lines' segments (lines x segments), of the substrings where other lines' segments may stand (lines x places), and which of these places there are.

    A key is of (segment's number, length of its line, substring); substrings have rolling hashes, from sums over a prefix of the line."""
    n = np.fromiter(map(len, own), np.int64, len(own))
    start = np.cumsum(n) - n
    pos = np.arange(int(n.sum())) - np.repeat(start, n)
    power, inverse = _power_table(int(n.max(initial=0)) + 1)
    code = np.frombuffer("".join(own).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sums = np.zeros(len(code) + 1, np.uint64)
    np.cumsum(mix(code + np.uint64(1)) * power[pos], out=sums[1:])

    def key(k: int, other: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        h = (sums[start + at + size] - sums[start + at]) * inverse[at]
        return signed(mix(h + (other * 64 + k).astype(np.uint64) * np.uint64(_BASE)))

    def segment(k: int, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        base, longer = np.divmod(other, t + 1)
        return k * base + np.maximum(0, k - (t + 1 - longer)), base + (k > t - longer)

    index = np.stack([key(k, n, *segment(k, n)) for k in range(t + 1)], 1)
    probes, there = np.zeros((len(own), len(places(t))), np.int64), np.zeros((len(own), len(places(t))), bool)
    for c, (delta, k, q) in enumerate(places(t)):
        other = np.maximum(n - delta, 0)
        at, size = segment(k, other)
        at = at + q
        there[:, c] = (n - delta > t) & (at >= 0) & (at + size <= n)
        probes[:, c] = key(k, other, np.where(there[:, c], at, 0), np.where(there[:, c], size, 0))
    return index, probes, there


def index_keys(line: str, t: int) -> list[int]:
    return line_keys([line], t)[0][0].tolist()


def probe_keys(line: str, t: int) -> list[int]:
    """Keys of the substrings that may equal a segment of another line, as long or up to t shorter; those of its own segments left out."""
    _, probes, there = line_keys([line], t)
    return probes[there].tolist()


def _spans(own: list[str], chars: int = 1 << 20) -> Iterator[slice]:
    """Slices of lines of so many code points together, or of one line."""
    at = total = 0
    for k, line in enumerate(own):
        if total and total + len(line) > chars:
            yield slice(at, k)
            at, total = k, 0
        total += len(line)
    if at < len(own):
        yield slice(at, len(own))


class Tally:
    """A filter with two places a key that also tells keys noted once from those noted again."""

    def __init__(self, words: np.ndarray | None = None):
        """words: rows of `_CHUNK` words of the first filter and as many of the second."""
        self.words = np.zeros(((1 << SEGMENT_BITS) // 64 // _CHUNK, 2, _CHUNK), np.uint64) if words is None else words

    def _at(self, keys: np.ndarray) -> np.ndarray:
        h = mix(np.ascontiguousarray(keys).view(np.uint64))
        return np.stack([h >> np.uint64(64 - SEGMENT_BITS), (h >> np.uint64(8)) & np.uint64((1 << SEGMENT_BITS) - 1)])

    def _bits(self, at: np.ndarray, again: int) -> np.ndarray:
        word = (at >> np.uint64(6)).astype(np.int64)
        return (self.words[word // _CHUNK, again, word % _CHUNK] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)

    def _note(self, at: np.ndarray, again: int) -> None:
        if len(at):  # sorted
            word = (at >> np.uint64(6)).astype(np.int64)
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            self.words[word[first] // _CHUNK, again, word[first] % _CHUNK] |= np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), first)

    def note(self, keys: np.ndarray) -> None:
        at, n = np.unique(self._at(keys).ravel(), return_counts=True)
        self._note(at[(n > 1) | self._bits(at, 0)], 1)
        self._note(at, 0)

    def noted(self, keys: np.ndarray, again: bool = False) -> np.ndarray:
        return self._bits(self._at(keys), int(again)).all(0)

    def rows(self, at_once: int = 32) -> Iterator[tuple[list[int], list[bytes]]]:
        """The filter as rows (chunk, counts), `at_once` of them together."""
        used = np.flatnonzero(self.words.any((1, 2))).tolist()
        for k in range(0, len(used), at_once):
            yield used[k : k + at_once], [self.words[c].tobytes() for c in used[k : k + at_once]]

    @staticmethod
    def together(a: np.ndarray | int, b: np.ndarray) -> np.ndarray:
        """Two tasks' parts of filters as one: what both noted was noted again."""
        if isinstance(a, int):
            return b
        a, b = a.reshape(2, _CHUNK), b.reshape(2, _CHUNK)
        return np.stack([a[0] | b[0], a[1] | b[1] | (a[0] & b[0])]).ravel()

    @classmethod
    def of(cls, partial: DataFrame) -> Tally:
        words = added_up(partial, (1 << SEGMENT_BITS) // 64 * 2, 2 * _CHUNK, cls.together)
        return cls(words.view(np.uint64).reshape(-1, 2, _CHUNK))


def within(a: str, b: str, t: int) -> bool:
    """Whether the edit distance is at most t: banded, bit-parallel, after equal ends are cut off."""
    if abs(len(a) - len(b)) > t:
        return False
    lo, hi = 0, min(len(a), len(b))
    if a[:hi] == b[:hi]:
        lo = hi
    while hi - lo > 1:  # the longest equal start, by halving
        mid = (lo + hi) // 2
        lo, hi = (mid, hi) if a[lo:mid] == b[lo:mid] else (lo, mid)
    if lo < min(len(a), len(b)) and a[lo] == b[lo]:
        lo += 1
    a, b = a[lo:], b[lo:]
    lo, hi = 0, min(len(a), len(b))
    while hi - lo > 1:
        mid = (lo + hi) // 2
        lo, hi = (mid, hi) if a[len(a) - mid : len(a) - lo] == b[len(b) - mid : len(b) - lo] else (lo, mid)
    if lo < min(len(a), len(b)) and a[len(a) - 1 - lo] == b[len(b) - 1 - lo]:
        lo += 1
    a, b = a[: len(a) - lo], b[: len(b) - lo]
    if min(len(a), len(b)) == 0:
        return max(len(a), len(b)) <= t
    if min(len(a), len(b)) <= t:
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1] <= t
    m, n, width = len(a), len(b), 2 * t + 1
    mask, at = (1 << width) - 1, {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    # bit r of column j is row j - t + r; before the first column only rows from 1 on have a vertical step
    vp, vn, score = (mask >> t) << t, 0, t
    for j in range(1, n + 1):
        low = j - t - 1
        p = at.get(b[j - 1], 0)
        p = (p >> low if low >= 0 else p << -low) & mask
        d0 = ((((p & vp) + vp) ^ vp) | p | vn) & mask
        hp, hn = (vn | ~(d0 | vp)) & mask, d0 & vp
        if j <= m - t:  # down the lower edge of the band
            score += not d0 >> 2 * t & 1
        else:  # along the last row
            r = m - j + t
            score += (hp >> r & 1) - (hn >> r & 1)
        if score - (n - max(j, m - t)) > t:
            return False
        x = d0 >> 1
        vp, vn = (hn | ~(x | hp)) & mask, x & hp
    return score <= t


@dataclass(frozen=True)
class FewEdits:
    """Whether counts of code points allow so few edits: each changes two counts at most."""

    edits: int

    def __call__(self, u: np.ndarray, un: int, v: np.ndarray, vn: np.ndarray) -> np.ndarray:
        return (np.abs(vn - un) <= self.edits) & (np.abs(v.astype(np.int32) - u.astype(np.int32)).sum(1) <= 2 * self.edits)


class LineDedup:
    def __init__(self, docs: DataFrame, edits: int = EDITS, fuzzy: int = FUZZY):
        if fuzzy <= edits:
            raise ValueError("lines of edits + 1 code points at least have segments")
        self.docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("doc"), "text")
        self.edits, self.fuzzy, self.spark = edits, fuzzy, docs.sparkSession
        self.scratch = Scratch(self.spark, "lines")

    def occurrences(self) -> tuple[DataFrame, DataFrame]:
        """(doc, digest, line, id, n) of lines that aren't blank, a row with nulls for texts without; and what `keys` takes."""
        edits, fuzzy = self.edits, self.fuzzy

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tally, seen = Tally(), set()
            for b in pieces(batches):
                rows, new, at = [], [], []
                for doc, text in zip(b.column("doc").to_pylist(), b.column("text").to_pylist(), strict=True):
                    text = text or ""
                    digest, before = line_id(text), len(rows)
                    for k, line in enumerate(text.split("\n")):
                        if not line or line.isspace():
                            continue
                        i = line_id(line)
                        if len(line) >= fuzzy and i not in seen:
                            if len(seen) > SEEN:
                                seen.clear()
                            seen.add(i)
                            new.append(line)
                            at.append(len(rows))
                        rows.append((doc, digest, k, i, len(line)))
                    if len(rows) == before:
                        rows.append((doc, digest, None, None, None))
                made = [line_keys(new[x], edits) for x in _spans(new)]
                index = np.concatenate([x[0] for x in made]) if made else np.empty((0, edits + 1), np.int64)
                probes = [x[1][x[2]] for x in made]
                if len(index):
                    tally.note(index.ravel())
                held = np.zeros((2, len(rows)), np.int64)
                held[0, at] = edits + 1
                held[1, at] = np.concatenate([x[2].sum(1) for x in made]) if made else 0
                ends = np.hstack([np.zeros((2, 1), np.int64), held.cumsum(1)]).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(e), pa.array(v)) for e, v in zip(ends, (index.ravel(), np.concatenate(probes) if probes else np.empty(0, np.int64)), strict=True)]
                if rows:
                    n = len(rows)
                    yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in zip(*rows, strict=True)), *lists, pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names)
            seen.clear()
            for chunks, counts in tally.rows():
                none = pa.nulls(len(chunks), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*[pa.nulls(len(chunks), pa.int64())] * 5, none, none, pa.array(chunks, pa.int32()), pa.array(counts, pa.binary())], names)

        names = ["doc", "digest", "line", "id", "n", "own", "probes", "chunk", "counts"]
        both = self.scratch.save(self.docs.mapInArrow(run, "doc long, digest long, line long, id long, n long, own array<long>, probes array<long>, chunk int, counts binary"), "lines")
        return both.where("chunk is null").select(*names[:5]), both

    def keys(self, looked: DataFrame) -> DataFrame:
        """(key, id, n) of lines long enough to differ by edits: probes for which there may be a segment, and segments that are probed or that several lines have."""
        tally = Tally.of(looked.where("chunk is not null").select("chunk", "counts"))
        lines = looked.where("size(own) > 0")

        def flat(column: str, wanted) -> DataFrame:
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                want = wanted()
                for b in batches:
                    held = b.column(column)
                    keys = held.flatten().to_numpy()
                    row = np.repeat(np.arange(b.num_rows), held.value_lengths().to_numpy(zero_copy_only=False))
                    kept = want(keys)
                    yield pa.RecordBatch.from_arrays([pa.array(keys[kept]), *(b.column(c).take(pa.array(row[kept])) for c in ("id", "n"))], ["key", "id", "n"])

            return lines.select("id", "n", column).mapInArrow(run, "key long, id long, n long")

        sent = self.spark.sparkContext.broadcast(tally.words)  # twice 2 ** SEGMENT_BITS bits
        probes = self.scratch.save(flat("probes", lambda: Tally(sent.value).noted), "probes")
        asked = self.spark.sparkContext.broadcast(seen_bits(probes, "key", PROBE_BITS))  # 2 ** PROBE_BITS bits

        def useful():
            own, bits = Tally(sent.value), asked.value
            return lambda keys: own.noted(keys, True) | spotted(bits, keys)

        return probes.unionByName(flat("own", useful))

    def look_up(self, ids: DataFrame) -> None:
        """Writes (id, t) of the given lines, once for all comparisons."""
        sent, fuzzy = self.spark.sparkContext.broadcast(seen_bits(ids, "id")), self.fuzzy  # 2 ** FILTER_BITS bits

        def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            words, seen = sent.value, set()
            for b in pieces(batches):
                lines = {i: line for text in b.column("text").to_pylist() for line in (text or "").split("\n") if len(line) >= fuzzy and not line.isspace() and (i := line_id(line)) not in seen}
                at = np.fromiter(lines, np.int64, len(lines))
                at = at[spotted(words, at)].tolist()
                if len(seen) > SEEN:
                    seen.clear()
                seen.update(at)
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array([lines[i] for i in at], pa.string())], ["id", "t"])

        self.texts = self.scratch.save(self.docs.select("text").mapInArrow(look, "id long, t string").dropDuplicates(["id"]).join(ids, "id", "left_semi"), "texts")

    def signatures(self, ids: DataFrame) -> DataFrame:
        """(id, sig): how often each of BUCKETS kinds of code points stands in a line."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in pieces(batches):
                sig = [np.minimum(np.bincount(np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) % BUCKETS, minlength=BUCKETS), 65535).astype(np.uint16).tobytes() for t in b.column("t").to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(sig, pa.binary())], ["id", "sig"])

        return self.texts.join(ids, "id", "left_semi").mapInArrow(run, "id long, sig binary")

    def verify(self, pairs: DataFrame) -> DataFrame | None:
        pairs = self.scratch.save(pairs, "pairs")
        if pairs.isEmpty():
            return None
        edits = self.edits

        def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in pieces(batches):
                ok = [within(x, y, edits) for x, y in zip(b.column("ut").to_pylist(), b.column("vt").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column("u"), b.column("v")], ["u", "v"]).filter(pa.array(ok, pa.bool_()))

        both = pairs.join(self.texts.selectExpr("id u", "t ut"), "u").join(self.texts.selectExpr("id v", "t vt"), "v")
        return self.scratch.save(both.select("u", "v", "ut", "vt").mapInArrow(check, "u long, v long"), "links")

    def removed(self) -> tuple[DataFrame, DataFrame]:
        """(doc, digest, line, first_doc, first_line) of lines with an earlier duplicate; and all occurrences."""
        all_, looked = self.occurrences()
        lines = all_.where("id is not null")
        edits = self.edits
        roots = Linker(self.scratch, lambda a, b: F.expr(f"abs({a} - {b}) <= {edits}"), self.verify, self.signatures, FewEdits(edits), self.look_up).roots(salted(self.scratch.save(self.keys(looked), "keys")))
        first = F.min(F.struct("doc", "line", "digest")).alias("f")
        own = lines.groupBy("id").agg(first, F.count("*").alias("c"))
        rooted = self.scratch.save(own.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id")), "firsts")
        merged = rooted.groupBy("root").agg(F.min("f").alias("f"), F.sum("c").alias("c")).where("c > 1")
        classes = rooted.select("id", "root").join(merged, "root").select("id", "f")
        again = lines.join(classes, "id").where("not (doc = f.doc and line = f.line and digest = f.digest)")
        return again.selectExpr("doc", "digest", "line", "f.doc first_doc", "f.line first_line"), all_


def duplicate_lines(docs: DataFrame, edits: int = EDITS, fuzzy: int = FUZZY) -> DataFrame:
    """What line dedup decides for each document (doc_id, text; other columns are ignored): a row per different (doc_id, text).

    doc_id, n_lines (that aren't blank), n_removed, removed: line:first_doc:first_line, comma-joined by line, for each line (from 0) of
    which a duplicate stands earlier, in the order of doc_id and line.  Blank lines are no duplicates; lines of fewer than `fuzzy`
    code points are duplicates if equal; duplicates of duplicates count.  Null and empty texts have no lines.
    Repeated rows are one document.  A null doc_id comes after all others (as 2**63 - 1 in `removed`).  An empty table gives no rows.
    """
    job = LineDedup(docs, edits, fuzzy)
    again, lines = job.removed()
    per = again.groupBy("doc", "digest").agg(F.count("*").alias("n_removed"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "first_doc", "first_line"))), lambda x: F.concat_ws(":", x["line"], x["first_doc"], x["first_line"])), ",").alias("removed"))
    have = lines.groupBy("doc", "digest").agg(F.count_distinct("line").alias("n_lines"))
    found = have.join(per, ["doc", "digest"], "left").select("doc", "n_lines", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("removed", F.lit("")).alias("removed"))
    return found.select(F.when(F.col("doc") != _LAST, F.col("doc")).alias("doc_id"), "n_lines", "n_removed", "removed")


def without_duplicates(docs: DataFrame, edits: int = EDITS, fuzzy: int = FUZZY) -> DataFrame:
    """The documents with the lines taken out that `duplicate_lines` removes, n_chars (if there) brought up to date.

    Documents of which no line is left, though they had some, go; all other columns stay as they are, whatever their names.
    Repeated rows are one document, so all of them stay, with the same lines.  Null and empty texts stay; so does an empty table."""
    job = LineDedup(docs, edits, fuzzy)
    again, _ = job.removed()
    gone = again.groupBy("doc", "digest").agg(F.collect_set("line").alias("gone"))  # a document's lines at most
    kept, held = docs.columns, "n_chars" in docs.columns

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            digest = [line_id(t or "") for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(digest, pa.int64())], ["row", "doc", "text", "digest"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            texts, ok = [], []
            for text, lines_ in zip(b.column("text").to_pylist(), b.column("gone").to_pylist(), strict=True):
                left = text
                if lines_:
                    own = set(lines_)
                    left = "\n".join(x for k, x in enumerate(text.split("\n")) if k not in own)
                texts.append(left)
                ok.append(not lines_ or bool(left.strip()))
            n = pa.array([None if t is None else len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(texts, pa.string()), n, b.column("gone").is_valid()], ["row", "text", "n", "cut"]).filter(pa.array(ok, pa.bool_()))

    # a row travels in a struct of its own, so its columns' names can't clash with those needed here
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("doc"), "text")
    fields = [T.StructField("row", rows.schema["row"].dataType), T.StructField("doc", T.LongType()), T.StructField("text", T.StringType())]
    found = rows.mapInArrow(keyed, T.StructType([*fields, T.StructField("digest", T.LongType())])).join(gone, ["doc", "digest"], "left").select("row", "text", "gone")
    left = found.mapInArrow(cut, T.StructType([fields[0], fields[2], T.StructField("n", T.LongType()), T.StructField("cut", T.BooleanType())]))
    new = {"text": F.col("text")} | ({"n_chars": F.when(F.col("cut"), F.col("n").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))} if held else {})
    return left.select(*(new.get(c, F.col(f"row.`{c}`")).alias(c) for c in kept))
