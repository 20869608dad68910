"""Line dedup, substring dedup and the pipeline: brute force and edge cases."""

import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparsolve.llm import common, linking, lines, passages
from sparsolve.llm.common import signed, word_hashes


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def edited(rng, text, n, letters):
    own = list(text)
    for _ in range(n):
        p, what = rng.randint(0, len(own)), rng.random()
        if what < 0.35 and own:
            own.pop(min(p, len(own) - 1))
        elif what < 0.7:
            own.insert(p, rng.choice(letters))
        elif own:
            own[min(p, len(own) - 1)] = rng.choice(letters)
    return "".join(own)


def test_kernels():
    rng = random.Random(1)
    for k in range(8000):
        t, letters = rng.choice([1, 2, 3]), "ab" if k % 2 else "abcdé"
        a = "".join(rng.choice(letters) for _ in range(rng.randint(0, 16)))
        b = edited(rng, a, rng.randint(0, 5), letters)
        d = distance(a, b)
        assert lines.within(a, b, t) == (d <= t), (a, b, t)
        if d <= t and min(len(a), len(b)) > t:
            s, x = sorted((a, b), key=len)
            assert set(lines.index_keys(s, t)) & {*lines.probe_keys(x, t), *(lines.index_keys(x, t) if len(s) == len(x) else [])}
    assert lines.within([1, 2, 3], [1, 3], 1) and lines.within("x" * 100_000, "x" * 99_999, 2)


def brute(rows, edits=2, fuzzy=24):
    places = defaultdict(list)
    for d, t in rows:
        for k, line in enumerate((t or "").split("\n")):
            if line.strip():
                places[line].append((d, k))
    known = sorted(places)
    root = {x: x for x in known}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, a in enumerate(known):
        for b in known[n + 1 :]:
            if min(len(a), len(b)) >= fuzzy and abs(len(a) - len(b)) <= edits and distance(a, b) <= edits:
                root[find(a)] = find(b)
    classes, out = defaultdict(list), defaultdict(list)
    for x in known:
        classes[find(x)] += places[x]
    for own in classes.values():
        first = min(own)
        for d, k in set(own) - {first}:
            out[d].append((k, *first))
    return {d: ",".join("{}:{}:{}".format(*x) for x in sorted(v)) for d, v in out.items()}


def line_docs(seed, n=40):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcdef ") for _ in range(rng.randint(20, 60))).strip() + "." for _ in range(12)]
    out = []
    for d in range(n):
        own = [edited(rng, rng.choice(base), rng.choice([0, 0, 1, 2, 3]), "abxyz") if rng.random() < 0.6 else f"own {d} {rng.random()}" for _ in range(rng.randint(1, 8))]
        out.append((d, "\n".join([*own, ""] if d % 3 else own)))
    return out


@pytest.mark.parametrize("short", [12, 2])
def test_lines_equal_brute_force(spark, monkeypatch, short):
    monkeypatch.setattr(linking, "SHORT", short)
    monkeypatch.setattr(linking, "BLOCK", 30)
    rows = line_docs(short)
    df = spark.createDataFrame([(*r, "a") for r in rows], "doc_id long, text string, digest string")
    got = {r["doc_id"]: r for r in lines.duplicate_lines(df).collect()}
    want = brute(rows)
    assert len(got) == len(rows) and {d: r["removed"] for d, r in got.items() if r["removed"]} == want
    assert all(r["n_removed"] == len(list(filter(None, r["removed"].split(",")))) for r in got.values())
    assert all(got[d]["n_lines"] == sum(bool(x.strip()) for x in t.split("\n")) for d, t in rows)


def test_lines_edge_cases(spark):
    rows = [(5, "a b c\n\nshort"), (1, "short\nx"), (2, None), (3, ""), (4, "\n \n"), (None, "short"), (1, "short\nx"), (6, "z" * 200_000), (7, "z" * 199_999 + "\nx")]
    df = spark.createDataFrame([(d, t, None, "s", None if t is None else len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: r["removed"] for r in lines.duplicate_lines(df).collect()}
    assert got == {5: "2:1:0", 1: "", 2: "", 3: "", 4: "", None: "0:1:0", 6: "", 7: "0:6:0,1:1:1"}
    left = sorted(((r["doc_id"], r["text"], r["n_chars"]) for r in lines.without_duplicates(df).collect()), key=str)
    assert left == sorted([(5, "a b c\n", 6), (1, "short\nx", 7), (1, "short\nx", 7), (2, None, None), (3, "", 0), (4, "\n \n", 3), (6, "z" * 200_000, 200_000)], key=str)
    assert lines.duplicate_lines(df.limit(0)).collect() == [] == lines.without_duplicates(df.limit(0)).collect()


def test_chains():
    rng = random.Random(0)
    for _ in range(60):
        m = sorted({(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(rng.randint(1, 14))})
        best = {}
        for k, (a, b) in enumerate(m):  # quadratic chaining
            best[k] = 5 + max([0.0, *(best[j] - 0.1 * (a - m[j][0] + b - m[j][1]) for j in range(k) if m[j][0] < a and m[j][1] < b)])
        tops = passages.chains(m, least=1)
        n = max(best, key=best.get)
        assert any(c[1] == m[n][0] + 5 and c[3] == m[n][1] + 5 for c in tops)
        assert all(c[0] < c[1] and c[2] < c[3] for c in tops)
    assert passages.chains([(0, 100), (4, 104), (8, 108), (300, 5)]) == [(0, 13, 100, 113)]


def passage_docs(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    shared = [[word() for _ in range(n)] for n in (60, 80, 55)]
    docs, holds = [], defaultdict(set)
    for d in range(60):
        own = [word() for _ in range(rng.randint(20, 200))]
        if d % 2 == 0:
            k = rng.randrange(3)
            passage = list(shared[k])
            if d % 4 == 0:
                passage[rng.randrange(len(passage))] = word()  # nearly so
            at = rng.randint(0, len(own))
            own[at:at] = passage
            holds[k].add(d)
        docs.append((d, " ".join(own)))
    return docs, holds


def brute_passages(rows):
    """class_id, n_class, n_passages, n_words, first_word, last_word, longest of each document, every pair of texts looked at."""
    texts = defaultdict(set)
    for d, t in rows:
        if d is not None and t is not None and len(common.plain_words(t.encode())) >= passages.PASSAGE:
            texts[t].add(d)
    known, of = sorted(texts), {}
    for t in known:
        h = common.word_hashes(common.plain_words(t.encode()))
        at, own = passages.seeds(h)
        of[t] = (common.signed(own), at, common.signed(h).astype(np.int32))
    count = defaultdict(int)
    for t in known:
        for k in set(of[t][0].tolist()):
            count[k] += 1
    keys, rare = {}, {}
    for t in known:
        h, at, _ = of[t]
        often = np.array([count[k] > passages.RARE for k in h.tolist()], bool)
        far = {(int(h[x]), int(h[y])) for k, x in enumerate(np.flatnonzero(often)) for y in [y for y in np.flatnonzero(often) if passages.NEAR <= at[y] - at[x] <= passages.FAR][: passages.NEXT]}
        keys[t] = far
        rare[t] = {k: [x[0] for x in passages.signatures([of[t][2]], [at[list(h).index(k)][None]])] for k in set(h.tolist()) if count[k] <= passages.RARE}
    root = {t: t for t in known}

    def find(t):
        while root[t] != t:
            t = root[t]
        return t

    for n, u in enumerate(known):
        for v in known[n + 1 :]:
            alike = any((rare[u][k][1] and rare[v][k][1]) or sum((x & y & (1 << 64) - 1).bit_count() for x, y in zip(rare[u][k][0].tolist(), rare[v][k][0].tolist())) >= passages.ALIKE for k in rare[u].keys() & rare[v].keys())
            if texts[u] & texts[v] or ((alike or keys[u] & keys[v]) and passages.shared_passages([(of[u], of[v])])[0]):
                root[find(u)] = find(v)
    members = defaultdict(list)
    for t in known:
        members[find(t)].append(t)
    out = {}
    for own in members.values():
        docs = set().union(*(texts[t] for t in own))
        for t in own:
            others = {k for x in own if x != t for k in of[x][0].tolist()}
            at = np.array([p for p, k in zip(of[t][1].tolist(), of[t][0].tolist()) if k in others], np.int64)
            runs = [(0, len(of[t][2]))] if len(texts[t]) > 1 else passages.runs_of(at) if len(own) > 1 and len(at) else []
            for d in texts[t]:
                was = out.get(d, (0, 0, 0, 0, None, None, None))
                some = [x for x in (was[4:] if was[4] is not None else None, (runs[0][0], runs[-1][1], max(e - s for s, e in runs)) if runs else None) if x]
                ends = (min(x[0] for x in some), max(x[1] for x in some), max(x[2] for x in some)) if some else (None, None, None)
                out[d] = (min(docs), len(docs), was[2] + len(runs), was[3] + sum(e - s for s, e in runs), *ends)
    return {d: out.get(d, (d, 1, 0, 0, None, None, None)) for d, _ in rows}


def found_passages(spark, rows):
    df = spark.createDataFrame([(*r, "q", 1) for r in rows], "doc_id long, text string, class_id string, root int")
    got = {r["doc_id"]: tuple(r)[1:] for r in passages.repeated_passages(df).collect()}
    assert len(got) == len({d for d, _ in rows})
    return got


@pytest.mark.parametrize(("short", "rare"), [(2, 8), (3, 2), (10**9, 8)])
def test_passages(spark, monkeypatch, short, rare):
    monkeypatch.setattr(passages, "SHORT", short)
    monkeypatch.setattr(passages, "RARE", rare)
    monkeypatch.setattr(linking, "BLOCK", 10)
    monkeypatch.setattr(linking, "SALT", 5)
    rows, holds = passage_docs(1)
    extra = [(100, None), (101, ""), (102, "too short"), (None, rows[0][1]), (0, rows[1][1] + " more"), (0, rows[0][1]), (103, "same word " * 40000), (104, "same word " * 300), (107, "three words over " * 300), (108, "own " + "three words over " * 200), (105, rows[3][1]), (106, rows[3][1].upper())]
    got = found_passages(spark, rows + extra)
    want = brute_passages(rows + extra)
    want[None] = (None, 1, 0, 0, None, None, None)
    assert got == want
    for own in holds.values():
        assert {got[d][0] for d in own} == {min(own)} and all(got[d][1] >= len(own) and got[d][6] >= passages.PASSAGE - 2 * (passages.WINDOW - 1) for d in own)
    assert got[103][0] == 103 and got[104][0] == 104 and got[105][0] == got[106][0] == 3 and got[107][0] == got[108][0] == 107  # one phrase of two words over and over is nothing
    assert passages.repeated_passages(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("short", [2, 10**9])
def test_overlapping_parts_of_one_text_equal_brute_force(spark, monkeypatch, short):
    monkeypatch.setattr(passages, "SHORT", short)
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    docs = []
    for _ in range(2):
        text = [word() for _ in range(300)]
        for _ in range(50):
            at = rng.randrange(len(text) - 60)
            docs.append([word() for _ in range(rng.randint(0, 20))] + text[at : at + 60] + [word() for _ in range(rng.randint(0, 20))])
    runs = {(x, y): longest_runs(a, b) for x, a in enumerate(docs) for y, b in enumerate(docs) if x != y}
    root = list(range(len(docs)))
    for _ in docs:
        for (x, y), r in runs.items():
            if r:
                root[x] = root[y] = min(root[x], root[y])
    rows = [(d, " ".join(t)) for d, t in enumerate(docs)]
    got = found_passages(spark, rows)
    assert got == brute_passages(rows)
    for x in range(len(docs)):
        own = [r for y in range(len(docs)) if x != y for r in runs[x, y]]
        assert got[x][0] <= root[x], x
        if own:  # seeds reach to within WINDOW - 1 words of a passage's ends
            assert got[x][4] <= min(r[1] for r in own) + passages.WINDOW - 1 and got[x][5] >= max(r[2] for r in own) - passages.WINDOW + 1, x


def longest_runs(a, b):
    """(length, start, end) in a of the maximal equal runs of a and b."""
    out = []
    for shift in range(-len(b) + 1, len(a)):
        run = 0
        for i in range(max(0, shift), min(len(a), len(b) + shift) + 1):
            if i < min(len(a), len(b) + shift) and a[i] == b[i - shift]:
                run += 1
            else:
                if run >= passages.PASSAGE:
                    out.append((run, i - run, i))
                run = 0
    return out


def test_matches_on_one_line_chain_as_others_do():
    rng = random.Random(4)
    for _ in range(300):
        at = sorted(rng.sample(range(400), rng.randint(2, 14)))
        line = [(x, x + 7) for x in at]
        slow = passages.chains([*line, (5000, 0)], least=1)  # a match on another line, after all others
        assert sorted(passages.chains(line, least=1)) == sorted(c for c in slow if c[0] < 5000)


def changed_pair(rng, n, share):
    """Two documents that share n words of which so many are replaced (their first and last are not)."""
    a = [rng.randrange(1 << 30) for _ in range(n)]
    b = list(a)
    for p in rng.sample(range(1, n - 1), int(n * share)):
        b[p] = rng.randrange(1 << 30)
    own = [[rng.randrange(1 << 30) for _ in range(rng.randint(0, 30))] for _ in range(4)]
    return own[0] + a + own[1], own[2] + b + own[3], (len(own[0]), len(own[0]) + n, len(own[2]), len(own[2]) + n)


def test_chains_extend_over_changed_words():
    rng = random.Random(3)
    for n, share in [(40, 0.2), (50, 0.1), (50, 0.2), (60, 0.15), (80, 0.2)] * 40:
        u, v, (a, b, c, d) = changed_pair(rng, n, share)
        at = max((p for p in range(n) if u[a + p] == v[c + p]), key=lambda p: next((k for k in range(n - p) if u[a + p + k] != v[c + p + k]), n - p))
        core = (a + at, a + at + 1, c + at, c + at + 1)  # a word of the longest equal run
        if max(at, n - at) > passages.REACH:
            continue
        (got,) = passages.aligned([(u, v, core)])
        assert got is not None and min(got[1] - got[0], got[3] - got[2]) >= passages.PASSAGE, (n, share)
        assert distance(u[got[0] : got[1]], v[got[2] : got[3]]) <= passages.DIFFER * max(got[1] - got[0], got[3] - got[2])
    for _ in range(300):
        a, b = ([rng.randrange(3) for _ in range(rng.randint(0, 14))] for _ in range(2))
        assert passages.edits(a, b, 20) == distance(a, b)


def test_passages_with_changed_words(spark):
    rng, docs = random.Random(8), []
    for n, share in [(50, 0.1), (50, 0.2), (60, 0.2), (80, 0.2)] * 25:
        docs += changed_pair(rng, n, share)[:2]
    df = spark.createDataFrame([(d, " ".join(f"w{x}" for x in t)) for d, t in enumerate(docs)], "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in passages.repeated_passages(df).collect()}
    assert sum(got[d] == got[d + 1] == d for d in range(0, len(docs), 2)) >= 95
    assert all(got[d] in (d, d - d % 2) for d in got)


def test_seeds_cover_runs():
    rng = np.random.default_rng(2)
    need = passages.SEED + passages.WINDOW - 1
    for _ in range(100):
        run = rng.integers(0, 1 << 60, need).astype(np.uint64)
        a, b = (np.concatenate([rng.integers(0, 1 << 60, int(rng.integers(0, 9))).astype(np.uint64), run, rng.integers(0, 1 << 60, int(rng.integers(0, 9))).astype(np.uint64)]) for _ in range(2))
        assert set(passages.seeds(a)[1].tolist()) & set(passages.seeds(b)[1].tolist())


def test_pipeline(spark, tmp_path):
    pytest.importorskip("corpus_pipeline")
    import corpus_pipeline

    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    long = [word() for _ in range(120)]
    item = " ".join(word() for _ in range(30))
    near = list(long)
    near[60] = "changed"
    texts = {1: " ".join(long), 2: " ".join(near), 3: "first own line of this document\n" + " ".join(word() for _ in range(50)), 4: "first own line of this document\n" + " ".join(word() for _ in range(50)), 5: " ".join(word() for _ in range(40)) + " " + item, 6: "123 !!", 7: None, 8: " ".join(long), 9: "clean words only here"}
    spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert tuple(docs.columns) == corpus_pipeline.COLUMNS
        kept.append({r["doc_id"]: r["text"] for r in docs.collect()})
    assert set(kept[0]) == {1, 2, 3, 4, 5, 8, 9}
    assert set(kept[1]) == {1, 2, 3, 4, 5, 9} and "first own" in kept[1][3] and "first own" not in kept[1][4]
    assert set(kept[2]) == {1, 3, 4, 5, 9} and set(kept[3]) == {1, 3, 4, 9}
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in packed} == {1, 3, 4, 9}


def test_pipeline_edge_cases(spark, tmp_path):
    """Null and repeated ids, equal rows, columns of other names, empty tables: stage by stage."""
    pytest.importorskip("corpus_pipeline")
    import corpus_pipeline as p

    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    text = lambda n=60: " ".join(word() for _ in range(n))
    item, one, two, three = text(30), text(), text(), text()
    near = one.rsplit(" ", 1)[0] + " else"
    rows = [(None, one), (5, near), (5, two), (7, two), (7, two), (8, three), (8, text(20) + " " + item), (None, text(10) + " " + item + " end"), (9, ""), (9, None), (None, None), (10, "99 ..."), (11, "x" * 100_000), (11, "x" * 100_000)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    df = spark.createDataFrame([(d, t, None if k % 2 else "en", "s", len(t or "")) for k, (d, t) in enumerate(rows)], schema).withColumns({"KEY": F.lit(1), "digest": F.lit("d"), "score": F.lit(0.5)})
    shown = lambda out: sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str)
    stage = dict(p.STAGES)
    told = stage["language ID"](spark, df, str(tmp_path))
    assert shown(told) == sorted([(d, t) for d, t in rows if t and t != "99 ..."], key=str) and told.where("lang is null").count() == 0
    assert shown(stage["language ID"](spark, df.withColumn("lang", F.lit(None).cast("string")), str(tmp_path))) == shown(told)  # nothing to learn from
    left = shown(stage["n-gram Jaccard join"](spark, df, str(tmp_path)))
    assert left == sorted([(5, near), (5, two), (8, three), *rows[6:13]], key=str)
    clean = shown(stage["benchmark decontamination"](spark, df, str(tmp_path)))
    assert clean == sorted([r for r in rows if item not in (r[1] or "")], key=str)
    lines_ = stage["line dedup"](spark, df, str(tmp_path))
    assert lines_.columns == list(p.COLUMNS) and {(None, None), (9, None), (9, ""), (5, near)} <= set(shown(lines_))
    for name, f in p.STAGES:
        out = f(spark, df.limit(0), str(tmp_path))
        assert out.collect() == [] and (name == "best-fit packing" or out.columns == list(p.COLUMNS))


def _as_text(words):
    h = word_hashes([w.encode() for w in words])
    at, own = passages.seeds(h)
    return signed(own), at, signed(h).astype(np.int32)


@pytest.mark.parametrize("changed", [False, True])
def test_frequent_seeds_match_at_all_places(changed):
    """A passage whose parts both texts also have often elsewhere, in other orders: no place of a seed is left out."""
    rng = np.random.default_rng(5)
    whole = [f"w{j}" for j in range(60)]
    parts = [whole[k : k + 20] for k in range(0, 41, 8)]
    fresh = iter(range(10**6))
    noise = lambda n: [f"n{next(fresh)}" for _ in range(n)]
    filler = lambda n: [w for _ in range(n) for k in rng.permutation(len(parts)) for w in [*parts[k], *noise(250)]]
    other = [w if k % 14 != 6 else f"changed{k}" for k, w in enumerate(whole)] if changed else whole
    u = _as_text([*filler(2), *whole, *noise(250), *filler(9)])
    v = _as_text([*filler(7), *other, *noise(250), *filler(5)])
    assert passages.shared_passages([(u, v)], whether=True)[0]
    assert not passages.shared_passages([(_as_text(filler(9)), _as_text(filler(12)))], whether=True)[0]


def test_arrow_batches_are_bounded_by_bytes(spark, tmp_path):
    """Long texts don't travel to Python by 10,000 rows, which several times over took an executor's memory."""
    from sparsolve.llm.common import BATCH_BYTES, Scratch

    Scratch(spark, "bound")
    sizes = lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"]) for b in batches)
    got = spark.range(8000).coalesce(1).selectExpr("repeat(cast(id as string), 800) t").mapInArrow(sizes, "n long").collect()
    assert len(got) > 1 and max(r["n"] for r in got) < 2 * BATCH_BYTES


def test_tally_rows_come_in_parts():
    tally = lines.Tally()
    tally.note(np.arange(100_000))
    parts = list(tally.rows())
    assert max(len(c) for c, _ in parts) <= 32 and sum(len(c) for c, _ in parts) == len(tally.words)
    assert all((np.frombuffer(raw, np.uint64) == tally.words[k].ravel()).all() for c, raws in parts for k, raw in zip(c, raws, strict=True))


def test_seed_keys_are_of_the_words():
    """Seeds of equal words are equal, others aren't; files and shuffles hold places and words only."""
    rng = np.random.default_rng(5)
    words = [rng.integers(0, 3, n).astype(np.int32) - 1 for n in (60, 0, 40, 5)]
    at = [np.arange(max(0, len(w) - passages.SEED + 1)) for w in words]
    keys = passages.seed_keys(words, at)
    assert [len(k) for k in keys] == [len(a) for a in at]
    held = {}
    for w, a, k in zip(words, at, keys, strict=True):
        for x, key in zip(a.tolist(), k.tolist(), strict=True):
            held.setdefault(key, set()).add(tuple(w[x : x + passages.SEED].tolist()))
    assert all(len(s) == 1 for s in held.values()) and len({s for x in held.values() for s in x}) == len(held)
    assert passages.seed_keys([], []) == []


def test_later_turns_look_at_mixed_lists_only(spark):
    """A list of one component isn't read again: after the first turn, what was mixed is gone through."""
    from sparsolve.llm.common import Scratch
    from sparsolve.llm.linking import Linker, salted

    rows = spark.createDataFrame([(k, i, 0) for k, ids in ((1, range(5)), (2, range(5, 10))) for i in ids], "key long, id long, n long")
    linker = Linker(Scratch(spark, "turns"), lambda a, b: F.lit(True), lambda p: p, lambda ids: ids.withColumn("sig", F.lit(b"\0\0")), lambda u, un, v, vn: np.ones(len(v), bool), short=2)
    lists = linker.lists(salted(rows))
    roots = spark.createDataFrame([(i, 0) for i in range(5)] + [(i, i % 2 + 5) for i in range(5, 10)], "id long, root long")
    assert linker.later_pairs(lists, roots, 1) is not None
    assert {r["key"] for r in linker.open.collect()} == {2}
    assert {(r["u"], r["v"]) for r in linker.later_pairs(lists, roots, 2).collect()} == {(a, b) for a in range(5, 10) for b in range(a + 1, 10) if (a - b) % 2}
