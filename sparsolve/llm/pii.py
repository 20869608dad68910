"""Personal data by fixed patterns and a skip-chain conditional random field.

The field's nodes are the chunks of a text (between white space) that hold a digit or an at sign; every other word is
clamped to "none", as no feature speaks for it.  Unary potentials look at a node's shape and the word before it.  Three kinds of
edges share potentials: neighbours in the text, the next repeat of the same chunk, and the next chunk of the same
shape.  Repeats are linked in a chain, not all with all, so edges grow with nodes.  Loopy sum-product message passing
runs over all documents of a slice at once, as one graph of separate parts.  Nodes inside a pattern's match are clamped
to its kind, so what the patterns know reaches distant repeats and look-alikes, which they miss by themselves: repeats, parts of
runs that a pattern took together and then dropped, and secrets (tokens, keys, passwords), for which there is no pattern.

Weights are learnt from the patterns' matches and from secrets that a word before them names; for half of the nodes that word is hidden, so shapes
are learnt too.  Documents set aside choose how sure the field must be: half of their matches are hidden, and of all nodes that the field then finds, a share of
PRECISION at least must be hidden matches.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces

KINDS = ("email", "ip", "card", "phone")
#: All that the field tells apart; the last has no pattern.
ALL = (*KINDS, "secret")
SECRET = len(KINDS)
NONE = len(ALL)
_LABELS = NONE + 1
#: Expected number of documents that weights are learnt from, at most.
SAMPLE_DOCS = 8000
#: A span is added where the field is at least as sure as this; documents set aside may ask for more.
SURE = 0.7
PRECISION = 0.98
#: One document of so many is set aside.
ASIDE = 4
#: Words that name a secret after them, and a secret's code points at least.
CUES = ("token", "secret", "key", "apikey", "api_key", "api-key", "password", "passwd", "pwd", "bearer")
SECRET_LEAST = 12
#: Code points from which a repeated chunk is the same thing.
REPEATED = 8
#: Nodes further apart than so many code points aren't neighbours.
NEAR = 40

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_ANY = re.compile(r"[0-9@]")
_CHUNK = re.compile(r"\S+")
_EDGE = "\"'()[]{}<>,;:!?.*#%&$|="


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if k % 2 == 0 else 2 * n - 9 * (n > 4)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    low, at = 0, text.find("@")
    while at >= 0:
        before = text[low:at]
        start = low + len(before.rstrip(_LOCAL))
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
        low = found.end() if found else at + 1
        at = text.find("@", low)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the patterns' matches, by kind, then start; leftmost, non-overlapping within a kind."""
    if not _ANY.search(text):
        return []
    out = [(0, *x) for x in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((3, m.start(), m.end()))
    return out


@dataclass
class Graph:
    """Nodes of several documents side by side; edges join nodes of one document."""

    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    features: np.ndarray  # nodes x features, 0 or 1
    label: np.ndarray  # of the pattern that covers the node, or NONE
    gold: np.ndarray  # label, or SECRET after a cue, or what a pattern finds in the chunk by itself, or what a repeat has
    edges: np.ndarray  # rows of (node, later node, type)


_WORDS = ("mail", "email", "phone", "tel", "call", "ip", "card", "version", "license")
_DIGITS = ((1, 2), (3, 3), (4, 4), (5, 8), (9, 12), (13, 19), (20, 1 << 60))
_HEX = re.compile(r"[0-9a-fA-F]+")
#: The last ones look at the word before.
_BEFORE = len(_WORDS) + 1
N_FEATURES = 1 + len(_DIGITS) + 16 + _BEFORE


def _features(core: str, word: str) -> list[int]:
    digits = sum("0" <= c <= "9" for c in core)
    letters = sum(c.isalpha() for c in core)
    dots = core.count(".")
    flags = (
        "@" in core, letters == 0, letters > 0, dots == 0, dots == 3, dots in (1, 2), dots > 3,
        "-" in core, core.startswith("+"), digits == len(core), letters + digits > 24,
        13 <= digits <= 19 and digits == len(core) and luhn(core), digits == len(core) and 13 <= digits <= 19, _octets(core),
        len(core) >= 16 and letters > 0 and _HEX.fullmatch(core) is not None, len(core) >= SECRET_LEAST and letters > 2 and digits > 1 and dots == 0 and "@" not in core,
    )
    return [1, *(int(a <= digits <= b) for a, b in _DIGITS), *map(int, flags), *(int(word == w) for w in _WORDS), int(word in CUES)]


def _octets(core: str) -> bool:
    return core.count(".") == 3 and core.replace(".", "").isascii() and all(x.isdigit() and int(x) <= 255 for x in core.split(".") if len(x) <= 3) and all(0 < len(x) <= 3 for x in core.split("."))


def _shape(core: str) -> str:
    return re.sub("[a-z]+", "a", re.sub("[0-9]", "9", core.lower()))


def graph(texts: list[str], base: list[list[tuple[int, int, int]]]) -> Graph:
    doc, start, end, features, label, gold, edges = [], [], [], [], [], [], []
    for d, text in enumerate(texts):
        if not _ANY.search(text):
            continue
        last, same, alike, kinds, cores, first = -1, {}, {}, {}, [], len(doc)
        cover = sorted((s, e, kind) for kind, s, e in base[d])
        c = 0
        for m in _CHUNK.finditer(text):
            raw = m[0]
            if not _ANY.search(raw):
                continue
            core = raw.strip(_EDGE)
            if not core:
                continue
            s = m.start() + raw.index(core)
            e = s + len(core)
            if "=" in core and (after := core.rpartition("=")[2].lstrip(_EDGE)):  # name=value
                core, s = after, e - len(after)
            word = (text[max(0, s - 24) : s].rstrip(_EDGE + " \n\t").split() or [""])[-1].lstrip(_EDGE).lower()
            while c < len(cover) and cover[c][1] <= s:
                c += 1
            n = len(doc)
            doc.append(d)
            start.append(s)
            end.append(e)
            features.append(_features(core, word))
            label.append(cover[c][2] if c < len(cover) and cover[c][0] < e else NONE)
            gold.append(SECRET if label[-1] == NONE and word in CUES and len(core) >= SECRET_LEAST else label[-1])
            if last >= 0 and s - end[last] <= NEAR:
                edges.append((last, n, 0))
            if core in same:
                edges.append((same[core], n, 1))
            shape = _shape(core)
            if shape in alike and alike[shape] != same.get(core):
                edges.append((alike[shape], n, 2))
            if gold[n] == NONE:  # the chunk by itself: a pattern may have lost it to what stands beside it
                gold[n] = next((kind for kind, x, y in base_spans(core) if (x, y) == (0, len(core))), NONE)
            if gold[n] != NONE and len(core) >= REPEATED:
                kinds[core] = gold[n]
            last, same[core], alike[shape] = n, n, n
            cores.append(core)
        for n in range(first, len(doc)):  # a repeat of what is known is known when weights are learnt
            if gold[n] == NONE:
                gold[n] = kinds.get(cores[n - first], NONE)
    return Graph(*(np.array(x, np.int64) for x in (doc, start, end)), np.array(features, float).reshape(-1, N_FEATURES), np.array(label, np.int64), np.array(gold, np.int64), np.array(edges, np.int64).reshape(-1, 3))


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))


def passing(unary: np.ndarray, pair: np.ndarray, edges: np.ndarray, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Node and edge beliefs of loopy message passing; pair: type x label x label."""
    k, a, b = unary.shape[1], edges[:, 0], edges[:, 1]
    theta = pair[edges[:, 2]]
    to_b, to_a = np.zeros((len(edges), k)), np.zeros((len(edges), k))

    def total() -> np.ndarray:
        node = unary.copy()
        np.add.at(node, b, to_b)
        np.add.at(node, a, to_a)
        return node

    for _ in range(rounds if len(edges) else 0):
        node = total()
        new_b = _log_sum((node[a] - to_a)[:, :, None] + theta, 1)
        new_a = _log_sum((node[b] - to_b)[:, None, :] + theta, 2)
        to_b = 0.5 * to_b + 0.5 * (new_b - new_b.max(1, keepdims=True))
        to_a = 0.5 * to_a + 0.5 * (new_a - new_a.max(1, keepdims=True))
    node = total()
    joint = (node[a] - to_a)[:, :, None] + (node[b] - to_b)[:, None, :] + theta
    joint = np.exp(joint - joint.max((1, 2), keepdims=True))
    belief = np.exp(node - node.max(1, keepdims=True))
    return belief / belief.sum(1, keepdims=True), joint / joint.sum((1, 2), keepdims=True)


@dataclass
class Field:
    weights: np.ndarray  # features x labels
    pair: np.ndarray  # type x label x label
    sure: float = SURE
    recall: float | None = None  # of the matches hidden in the documents set aside; None: there were none

    def beliefs(self, g: Graph, hidden: np.ndarray | None = None) -> np.ndarray:
        """hidden: nodes of which the patterns' matches aren't made known."""
        unary = g.features @ self.weights
        known = np.flatnonzero(g.label != NONE if hidden is None else (g.label != NONE) & ~hidden)
        unary[known] = -50.0
        unary[known, g.label[known]] = 0.0
        return passing(unary, self.pair, g.edges)[0]

    def chosen(self, g: Graph, least: float = SURE) -> Field:
        """With the least threshold (from `least` on) that keeps to PRECISION on documents set aside, half of whose matches are hidden."""
        hidden = np.arange(len(g.doc)) % 2 == 0
        node = self.beliefs(g, hidden) if len(g.doc) else np.zeros((0, _LABELS))
        best = node[:, :NONE].argmax(1)
        p, right = node[np.arange(len(node)), best], best == g.gold
        asked = hidden & (g.gold != NONE)
        open_ = hidden | (g.label == NONE)
        if not asked.any():
            return Field(self.weights, self.pair, least, None)
        order = [t for t in (least, 0.8, 0.9, 0.95, 0.98, 0.99, 0.999) if t >= least]
        fine = (t for t in order if (right & open_ & (p >= t)).sum() >= PRECISION * (open_ & (p >= t)).sum())
        sure = next(fine, 1.1)
        return Field(self.weights, self.pair, sure, float((right & asked & (p >= sure)).sum() / asked.sum()))


def learn(g: Graph, steps: int = 120, rate: float = 0.3, penalty: float = 1.0) -> Field:
    """Maximum likelihood by adaptive gradient steps; expectations come from message passing.

    The patterns' kinds and named secrets are the labels; the features don't include the match itself, and half of the nodes don't show the word before."""
    f = Field(np.zeros((N_FEATURES, _LABELS)), np.zeros((3, _LABELS, _LABELS)))
    if not len(g.doc):
        f.weights[0, NONE] = 10.0
        return f
    gold = np.eye(_LABELS)[g.gold]
    seen = np.zeros_like(f.pair)
    np.add.at(seen, (g.edges[:, 2], g.gold[g.edges[:, 0]], g.gold[g.edges[:, 1]]), 1.0)
    features = g.features.copy()
    features[::2, -_BEFORE:] = 0.0
    at = features.T @ gold
    past_w, past_p = np.zeros_like(f.weights), np.zeros_like(f.pair)
    for _ in range(steps):
        node, joint = passing(features @ f.weights, f.pair, g.edges, 6)
        dw = at - features.T @ node - penalty * f.weights
        dp = seen - penalty * f.pair
        np.subtract.at(dp, g.edges[:, 2], joint)
        past_w += dw**2
        past_p += dp**2
        f.weights += rate * dw / np.sqrt(past_w + 1e-9)
        f.pair += rate * dp / np.sqrt(past_p + 1e-9)
    return f


def _merged(spans: list[tuple[int, int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the stretches that the spans cover."""
    starts, ends = [], []
    for _, s, e in sorted(spans, key=lambda x: x[1:]):
        if ends and s <= ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    return starts, ends


def added_spans(g: Graph, node: np.ndarray, base: list[list[tuple[int, int, int]]], sure: float) -> list[list[tuple[int, int, int]]]:
    """What the field adds, per document: sure nodes outside the patterns' matches, neighbours of a kind as one span."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in base]
    best = node[:, :NONE].argmax(1) if len(node) else np.zeros(0, int)
    taken = [_merged(spans) for spans in base]
    for n in np.flatnonzero((g.label == NONE) & (node[np.arange(len(node)), best] >= sure)) if len(node) else ():
        d, kind, s, e = int(g.doc[n]), int(best[n]), int(g.start[n]), int(g.end[n])
        k = bisect_left(taken[d][0], e) - 1  # the last match that starts before this node ends
        if k >= 0 and taken[d][1][k] > s:
            continue
        last = out[d][-1] if out[d] else None
        if kind == 3 and last and last[0] == 3 and 0 <= s - last[2] <= 2:
            out[d][-1] = (3, last[1], e)
        else:
            out[d].append((kind, s, e))
    return out


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{ALL[k]}:{s}:{e}" for k, s, e in sorted(spans))


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Field:
    """Weights from the documents of a hashed sample of `sample_docs` expected rows, less those set aside; only nodes reach the driver."""
    n = docs.count()
    part = min(1.0, sample_docs / max(n, 1))
    chosen = docs.where(F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(1 << 30)) < int(part * (1 << 30))).select(F.col("doc_id").cast("long"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            texts = [x or "" for x in b.column("text").to_pylist()]
            g = graph(texts, [base_spans(x) for x in texts])
            if len(g.doc):
                aside = np.array([zlib.crc32(str(d).encode()) % ASIDE == 0 for d in b.column("doc_id").to_pylist()], np.int64)[g.doc]
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (np.packbits(g.features.astype(bool), axis=1), g.label, g.gold, g.edges, aside)], names)

    names = ["features", "label", "gold", "edges", "aside"]
    parts = []
    for r in chosen.mapInArrow(run, ", ".join(f"{c} binary" for c in names)).toArrow().to_pylist():
        label, gold, aside = (np.frombuffer(r[c], np.int64) for c in ("label", "gold", "aside"))
        bits = np.unpackbits(np.frombuffer(r["features"], np.uint8).reshape(len(label), -1), axis=1)[:, :N_FEATURES].astype(float)
        parts.append((bits, label, gold, np.frombuffer(r["edges"], np.int64).reshape(-1, 3), aside))

    def side(which: int) -> Graph:
        out, base = [(np.zeros((0, N_FEATURES)), *[np.zeros(0, np.int64)] * 2, np.zeros((0, 3), np.int64))], 0
        for bits, label, gold, edges, aside in parts:
            own = aside == which
            place = np.cumsum(own) - 1 + base
            kept = edges[own[edges[:, 0]]]  # edges join nodes of one document
            out.append((bits[own], label[own], gold[own], np.column_stack([place[kept[:, :2]], kept[:, 2:]])))
            base += int(own.sum())
        f, label, gold, edges = (np.concatenate(x) for x in zip(*out, strict=True))
        zero = np.zeros(len(label), np.int64)
        return Graph(zero, zero, zero, f, label, gold, edges)

    return learn(side(0)).chosen(side(1))


def find(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sure: float | None = None, field: Field | None = None) -> DataFrame:
    """Personal data in each document (doc_id, text; other columns are ignored), a row per row of `docs`.

    doc_id, n_email, n_ip, n_card, n_phone (the patterns' matches), base_sha256 (of their spans), spans (all spans as
    kind:start:end in code points, by kind, then start, comma-joined; the field's may be secrets too), n_added (those of the field), n_spans (all).
    sure: how sure the field must be (over 1: it adds nothing), instead of what documents set aside ask for; field: one that was learnt before.
    Null and empty texts hold nothing; very long ones are looked at whole.  Repeated rows come as often; an empty table gives no rows; doc_id may be null.
    """
    field = field or fit(docs, sample_docs)
    sure = field.sure if sure is None else sure

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            texts = [x or "" for x in b.column("text").to_pylist()]
            base = [base_spans(x) for x in texts]
            g = graph(texts, base)
            more = added_spans(g, field.beliefs(g), base, sure)
            out = []
            for doc, own, new in zip(b.column("doc_id").to_pylist(), base, more, strict=True):
                out.append((doc, *(sum(s[0] == k for s in own) for k in range(len(KINDS))), hashlib.sha256(_joined(own).encode()).hexdigest(), _joined(own + new), len(new), len(own) + len(new)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added", "n_spans"]
    types = [pa.int64()] * 5 + [pa.string(), pa.string(), pa.int64(), pa.int64()]
    schema = "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string, n_added long, n_spans long"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)
