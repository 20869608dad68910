"""Language identification: sparse multinomial logistic regression on TF-IDF of hashed character n-grams.

Document frequencies come from all labelled documents that may be learnt from.  Weights come from a bounded hashed sample of
them, by follow-the-regularised-leader steps with elastic-net penalties (l1 leaves most weights at zero); a part of the sample
that these steps don't see sets the temperature of the reported probabilities.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import added_up, mix, pieces

#: Hashed n-grams, and the n.
BITS = 15
GRAMS = (1, 2, 3)
#: Expected number of documents that weights are learnt from, at most.
SAMPLE_DOCS = 4000
#: Chunks in which counts travel.
_CHUNK = 1024
_LETTER = re.compile(r"[^\W\d_]")
_SPACE = 32
_LOW = 0x3000
_FOLD = np.array([ord(c.lower()) if (c := chr(x)).isalpha() and len(c.lower()) == 1 else _SPACE for x in range(_LOW)], np.uint32)


def grams(text: str) -> np.ndarray:
    """The hashed n-grams of the whole text, with a space for every run of what is no letter."""
    x = np.frombuffer(f" {text} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    x = np.where(x < _LOW, _FOLD[np.minimum(x, _LOW - 1)], x)
    x = x[~((x == _SPACE) & np.r_[False, x[:-1] == _SPACE])].astype(np.uint64)
    out = []
    for n in GRAMS:
        h = np.full(max(0, len(x) - n + 1), n, np.uint64)
        for j in range(n):
            h = h * np.uint64(0x9E3779B97F4A7C15) + x[j : len(x) - n + 1 + j]
        out.append(mix(h) >> np.uint64(64 - BITS))
    return np.concatenate(out).astype(np.int64)


def counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    n = np.bincount(grams(text), minlength=1 << BITS)
    at = np.flatnonzero(n)
    return at, n[at]


def weighted(at: np.ndarray, n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = (1.0 + np.log(n)) * idf[at]
    return x / max(1e-12, np.sqrt(x @ x))


def held_out() -> F.Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("long").cast("string")), F.lit(4)) == 2


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray  # n-grams (and a constant, last) x languages
    idf: np.ndarray
    temperature: float = 1.0

    def logits(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        return weighted(at, n, self.idf) @ self.weights[at] + self.weights[-1]

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.langs or not text or not _LETTER.search(text):
            return "und", 0.0
        z = self.logits(*counts(text)) / self.temperature
        p = np.exp(z - z.max())
        return self.langs[int(p.argmax())], float(p.max() / p.sum())


class _Counted(Sequence):
    """Documents as (n-grams, weights, language), made from their counts when they are read: a sixth of the memory."""

    def __init__(self, rows: list[tuple[bytes, bytes, int]], idf: np.ndarray):
        self.rows, self.idf = rows, idf

    def __len__(self) -> int:
        return len(self.rows)

    def __getitem__(self, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        at, n, y = self.rows[k]
        at = np.frombuffer(at, np.uint16).astype(np.int64)
        return at, weighted(at, np.frombuffer(n, np.uint16).astype(float), self.idf), y


def follow_the_leader(rows: Sequence[tuple[np.ndarray, np.ndarray, int]], n_langs: int, epochs: int = 4, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.05, l2: float = 0.1) -> np.ndarray:
    """FTRL-proximal: per-coordinate rates, weights in closed form from the summed gradients; the constant isn't penalised by l1."""
    z, s = np.zeros(((1 << BITS) + 1, n_langs)), np.zeros(((1 << BITS) + 1, n_langs))
    limit = np.full((1 << BITS) + 1, l1)
    limit[-1] = 0.0

    def weights(at: np.ndarray | slice) -> np.ndarray:
        k = limit[at][:, None]
        return np.where(np.abs(z[at]) <= k, 0.0, -(z[at] - np.sign(z[at]) * k) / ((beta + np.sqrt(s[at])) / alpha + l2))

    rng = np.random.default_rng(7)
    for _ in range(epochs):
        for r in rng.permutation(len(rows)):
            at, x, y = rows[r]
            at, x = np.append(at, 1 << BITS), np.append(x, 1.0)
            w = weights(at)
            v = x @ w
            p = np.exp(v - v.max())
            p /= p.sum()
            p[y] -= 1.0
            g = x[:, None] * p
            sigma = (np.sqrt(s[at] + g * g) - np.sqrt(s[at])) / alpha
            z[at] += g - sigma * w
            s[at] += g * g
    return weights(slice(None))


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log loss, by golden-section search on its logarithm.

    As in Platt's targets, a label counts (n + 1) / (n + languages), so that a sample without errors doesn't make everything certain."""
    if not len(y):
        return 1.0

    smooth = np.full(logits.shape, 1.0 / (len(y) + logits.shape[1]))
    smooth[np.arange(len(y)), y] = (len(y) + 1.0) / (len(y) + logits.shape[1])
    smooth /= smooth.sum(1, keepdims=True)

    def loss(t: float) -> float:
        v = logits / np.exp(t)
        v = v - v.max(1, keepdims=True)
        return float((np.log(np.exp(v).sum(1)) - (smooth * v).sum(1)).mean())

    a, b, r = np.log(0.02), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(60):
        c, d = b - r * (b - a), a + r * (b - a)
        a, b = (a, d) if loss(c) <= loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many of the documents each n-gram is, and how many documents there are."""
    width = (1 << BITS) + _CHUNK  # the last chunk counts documents

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width, np.int64)
        for b in pieces(batches):
            for text in b.column("text").to_pylist():
                total[counts(text or "")[0]] += 1
            total[1 << BITS] += b.num_rows
        rows = [(k, total[k * _CHUNK : (k + 1) * _CHUNK].tobytes()) for k in range(width // _CHUNK) if total[k * _CHUNK : (k + 1) * _CHUNK].any()]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["chunk", "counts"])

    total = added_up(docs.select("text").mapInArrow(run, "chunk int, counts binary"), width, _CHUNK)
    return total[: 1 << BITS], int(total[1 << BITS])


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Model:
    """Learns from `text` and non-null `lang` of all rows of `docs`; weights from a hashed sample of `sample_docs` expected rows."""
    docs = docs.where(F.col("lang").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    df, n = document_frequencies(docs)
    idf = np.log((1 + n) / (1 + df)) + 1
    part = min(1.0, sample_docs / max(n, 1))
    chosen = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(part * (1 << 30)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            rows = [(d, y, at.astype(np.uint16).tobytes(), np.minimum(c, 65535).astype(np.uint16).tobytes()) for d, t, y in zip(*(b.column(k).to_pylist() for k in ("doc_id", "text", "lang")), strict=True) for at, c in [counts(t or "")]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.binary(), pa.binary()), strict=True)], ["doc_id", "lang", "at", "n"])

    rows = chosen.mapInArrow(run, "doc_id long, lang string, at binary, n binary").toArrow().to_pylist()  # about sample_docs rows of n-gram counts
    rows.sort(key=lambda r: (r["doc_id"], r["lang"], r["at"]))
    langs = sorted({r["lang"] for r in rows})
    if not langs:
        return Model([], np.zeros(((1 << BITS) + 1, 0)), idf)
    data = _Counted([(r["at"], r["n"], langs.index(r["lang"])) for r in rows], idf)
    aside = [zlib.crc32(str(r["doc_id"]).encode()) // 4 % 5 == 0 for r in rows]
    del rows
    own = [x for x, a in zip(data.rows, aside, strict=True) if not a] or data.rows
    w = follow_the_leader(_Counted(own, idf), len(langs))
    kept = [x for x, a in zip(data.rows, aside, strict=True) if a]
    logits = np.array([x @ w[at] + w[-1] for at, x, _ in _Counted(kept, idf)]).reshape(-1, len(langs))
    return Model(langs, w, idf, temperature(logits, np.array([y for *_, y in kept], int)))


def predict(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep` with lang_pred and score (its calibrated probability, 0 to 1).

    Only the text is looked at.  Null and letterless texts: "und" with score 0; so is everything if nothing could be learnt."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # fixed size: 2 ** BITS n-grams x languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in pieces(batches):
            got = [m.predict(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], [*keep, "lang_pred", "score"])

    fields = docs.select(*keep).schema.add("lang_pred", "string").add("score", "double")
    return docs.select(*dict.fromkeys((*keep, "text"))).mapInArrow(run, fields)


def identify(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each document (doc_id, text, lang; other columns are ignored).

    Documents for which crc32(doc_id as text) mod 4 is 2 are held out: nothing is learnt from them, nor from null doc_ids or langs.
    Repeated rows count and come as often; an empty table gives no rows; a null doc_id isn't held out.
    """
    model = fit(docs.where(~held_out()), sample_docs)
    marked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("held_out", F.coalesce(held_out(), F.lit(False)))
    return predict(marked, model, ("doc_id", "held_out"))
