import json
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparsolve.llm import packing

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from(list("ab é\n\t\xa0'sß1.,中 ")), max_size=30))
def test_encoder_equals_the_library(text):
    enc = packing.encoder(PATH)
    assert np.frombuffer(enc(text), "<u4").tolist() == enc.whole.encode(text, add_special_tokens=False).ids


def test_encoder_special_and_words():
    enc = packing.encoder(PATH)
    for text in ("a <|endoftext|> b", "Don't we'll  x \n \n y", " lead", "tail ", "ça\xa0 va \xa0x"):
        assert np.frombuffer(enc(text), "<u4").tolist() == enc.whole.encode(text, add_special_tokens=False).ids


def test_cut():
    assert packing.cut(5, 4) == [(0, 1), (1, 4)]
    assert packing.cut(8, 4) == [(0, 4), (4, 4)]
    assert packing.cut(1, 4) == [(0, 1)]


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 40), max_size=12))
def test_plan_places_everything(counts):
    got, total = defaultdict(list), 0
    for s, r0, first, per, offset, n in packing.plan(counts, 30):
        for r in range(n):
            got[first + r // per].append((offset + r % per * s, s))
        total += n
    assert total == sum(counts.values())
    for items in got.values():
        at = 0
        for offset, s in sorted(items):
            assert offset == at
            at += s
        assert at <= 30
        assert sum(3 * s > 30 for _, s in items) <= 2
    volume = sum(s * c for s, c in counts.items())
    assert len(got) <= max(1, -(-volume // 30) * 1.23 + 2) or any(2 * s > 30 for s in counts)


def test_pack(spark):
    docs = spark.createDataFrame([(1, "a b c", 9), (2, None, 9), (3, "", 9), (None, "x", 9), (1, "a b c", 9), (4, "word " * 90, 9)], "doc_id long, text string, sequence_id int")
    rows = packing.pack(docs, PATH, 32, ids=True).collect()
    by = defaultdict(list)
    for r in rows:
        assert r["length"] == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in by.values():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at
            at += n
        assert at <= 32
    assert sum(r["doc_id"] == 1 for r in rows) == 2
    whole = sorted((r["piece"], r["ids"]) for r in rows if r["doc_id"] == 4)
    text = packing.encoder(PATH).whole.decode([i for _, ids in whole for i in ids][:-1])
    assert text == "word " * 90
    assert packing.pack(docs.limit(0), PATH, 32).collect() == []


def test_other_tokenizer_files_take_the_library(tmp_path):
    """Files that aren't plain byte-level BPE give the library's ids, not those of another pattern."""
    other = packing.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    told = json.loads(open(PATH, encoding="utf-8").read())
    told["pre_tokenizer"]["add_prefix_space"] = True
    (tmp_path / "prefixed.json").write_text(json.dumps(told))
    told["pre_tokenizer"]["add_prefix_space"] = False
    told["added_tokens"].append(told["added_tokens"][0] | {"id": 50257, "content": "<sep>", "special": False})
    (tmp_path / "added.json").write_text(json.dumps(told))
    for enc, plain in ((other, None), (packing.Encoder(str(tmp_path / "prefixed.json")), True), (packing.Encoder(str(tmp_path / "added.json")), False)):
        assert plain is None or (enc.bpe is None) == plain
        for text in ("Hello  world, it's 12 o'clock.", "a<sep>b <|endoftext|> c", " é\n\n x", ""):
            assert np.frombuffer(enc(text), "<u4").tolist() == enc.whole.encode(text, add_special_tokens=False).ids
