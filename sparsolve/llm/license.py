"""License scans by an exact set-similarity join of text blocks with license templates.

Blocks are overlapping windows of words, templates are word sets.  A block meets a template if it holds at least
`threshold` of the template's words.  Words are ordered by how often they occur in the whole corpus, rarest first; then a
block that meets a template of m words with c needed must hold one of the template's first m - c + 1 words (prefix filter).
The length filter (distinct words of the block) and the positional filter (what can still match after the
shared word, on either side) come next, and the overlap is counted last.  Base phrases are templates of which
all words are needed; their places are then checked word by word inside the blocks that meet them.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, plain_words, utf8

#: The base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Further templates: usual notices of public licenses, with their labels.
NOTICES = {
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files": "mit",
    "licensed under the apache license version 2 0": "apache-2.0",
    "you may not use this file except in compliance with the license you may obtain a copy of the license at": "apache-2.0",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd",
    "licensed under the gnu general public license version 3": "gpl-3",
    "licensed under the gnu general public license version 2": "gpl-2",
    "licensed under the gnu lesser general public license": "lgpl",
    "subject to the terms of the mozilla public license": "mpl",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "licensed under cc by sa 4 0": "cc-by-sa",
    "licensed under cc by nd 4 0": "cc-by-nd",
    "licensed under a creative commons attribution 4 0 international license": "cc-by",
    "this is free and unencumbered software released into the public domain": "unlicense",
}
#: Words of a block; blocks start at every half of it, so that runs of up to BLOCK // 2 + 1 words lie whole in one.
BLOCK = 64


@dataclass(frozen=True)
class Template:
    words: tuple[bytes, ...]  # as they stand
    label: str
    exact: bool  # a base phrase: all its words, in a row
    order: tuple[bytes, ...] = ()  # distinct, rarest first
    need: int = 0


def templates(base: dict[str, str], notices: dict[str, str], threshold: float, count: dict[bytes, int]) -> list[Template]:
    out = []
    for exact, phrases in ((True, base), (False, notices)):
        for phrase, label in phrases.items():
            words = tuple(plain_words(phrase.encode()))
            if exact and len(words) > BLOCK // 2 + 1:
                raise ValueError(f"a base phrase has at most {BLOCK // 2 + 1} words: {phrase}")
            order = tuple(sorted(set(words), key=lambda w: (count.get(w, 0), w)))
            out.append(Template(words, label, exact, order, len(order) if exact else math.ceil(threshold * len(order) - 1e-9)))
    return out


class Scanner:
    """The join's probe side: templates as an inverted index of prefix words."""

    def __init__(self, found: list[Template], count: dict[bytes, int]):
        self.templates = found
        vocabulary = sorted({w for t in found for w in t.order}, key=lambda w: (count.get(w, 0), w))
        self.rank = {w: k for k, w in enumerate(vocabulary)}
        self.index: dict[bytes, list[tuple[int, int]]] = {}
        for k, t in enumerate(found):
            for at, w in enumerate(t.order[: len(t.order) - t.need + 1]):
                self.index.setdefault(w, []).append((k, at))
        self.prefix = frozenset(self.index)

    def __call__(self, words: list[bytes]) -> tuple[list[tuple[int, str]], list[tuple[str, int, float]]]:
        """The base phrases' (place, label), in order; the blocks' (label, first word, containment)."""
        if self.prefix.isdisjoint(words):
            return [], []
        step, places, blocks, held = BLOCK // 2, set(), {}, {}
        candidates: dict[tuple[int, int], list[tuple[bytes, int]]] = {}
        for p, w in enumerate(words):
            for k, at in self.index.get(w, ()):
                for b in {max(0, p // step - 1), p // step}:
                    if p < b * step + BLOCK:
                        candidates.setdefault((b, k), []).append((w, at))
        for (b, k), shared in candidates.items():
            t = self.templates[k]
            if b not in held:
                own = words[b * step : b * step + BLOCK]
                held[b] = own, len(set(own)), sorted({self.rank[w] for w in own if w in self.rank})
            own, size, ranks = held[b]
            if size < t.need:  # length filter
                continue
            w, at = min(shared, key=lambda x: x[1])
            if min(len(t.order) - at, sum(r >= self.rank[w] for r in ranks)) < t.need:  # positional filter: nothing before this word is shared
                continue
            overlap = len(set(t.order).intersection(own))
            if overlap < t.need:
                continue
            if not t.exact:
                blocks[t.label, b * step] = max(blocks.get((t.label, b * step), 0.0), overlap / len(t.order))
                continue
            n = len(t.words)
            places.update((b * step + i, t.label) for i in range(len(own) - n + 1) if own[i] == t.words[0] and tuple(own[i : i + n]) == t.words)
        return sorted(places), [(label, at, score) for (label, at), score in sorted(blocks.items(), key=lambda x: (x[0][1], x[0][0]))]


def word_counts(docs: DataFrame, vocabulary: frozenset[bytes]) -> dict[bytes, int]:
    """How often each word of the templates occurs in all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for b in pieces(batches):
            for text in utf8(b.column("text")):
                total.update([w for w in plain_words(text) if w in vocabulary])
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

    return {bytes(r["word"]): r["n"] for r in docs.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}  # a row per template word at most


def scan(docs: DataFrame, base: dict[str, str] | None = None, notices: dict[str, str] | None = None, threshold: float = 0.9) -> DataFrame:
    """License findings of each document (doc_id, text; other columns are ignored), a row per row of `docs`.

    doc_id, n_words, n_base (places of base phrases), first_word, last_word (least and greatest place, else null),
    base_labels, labels (distinct, sorted, comma-joined; empty if none), score (highest containment, 0 to 1), and blocks,
    an array of (label, first_word, containment) for the blocks that meet a notice.
    Null and empty texts have no words.  Repeated rows come as often; an empty table gives no rows; doc_id may be null.
    """
    base, notices = BASE if base is None else base, NOTICES if notices is None else notices
    vocabulary = frozenset(w for phrase in (*base, *notices) for w in plain_words(phrase.encode()))
    count = word_counts(docs, vocabulary)
    known = templates(base, notices, threshold, count)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(known, count)
        for b in pieces(batches):
            out = []
            for doc, text in zip(b.column("doc_id").to_pylist(), utf8(b.column("text")), strict=True):
                words = plain_words(text)
                places, blocks = scanner(words)
                own = {label for _, label in places}
                out.append((doc, len(words), len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(sorted(own)), ",".join(sorted(own | {x[0] for x in blocks})), 1.0 if places else max((x[2] for x in blocks), default=0.0), [dict(zip(("label", "first_word", "containment"), x, strict=True)) for x in blocks]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "blocks"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("containment", pa.float64())]))]
    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, blocks array<struct<label: string, first_word: long, containment: double>>"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)
