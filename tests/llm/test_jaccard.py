import itertools
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from sparsolve.llm import jaccard, linking
from sparsolve.llm.common import Scratch, connected


def brute(rows, k, num, den):
    sets, root = {}, {}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])
        root[i] = i
    lists, shared = defaultdict(list), Counter()
    for i, s in sets.items():
        for x in s:
            lists[x].append(i)
    for own in lists.values():
        shared.update(itertools.combinations(sorted(own), 2))
    for (a, b), o in shared.items():
        if den * o >= num * (len(sets[a]) + len(sets[b]) - o):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def texts(seed, groups=12, each=9, words=(6, 90), edits=5):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(300)]
    out = []
    for _ in range(groups):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(*words))]
        for _ in range(each):
            own = list(base)
            for _ in range(rng.randint(0, edits)):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                own += [rng.choice(vocabulary) for _ in range(rng.randint(1, 4))]
            out.append(" ".join(own))
    rng.shuffle(out)
    return list(enumerate(out, 100))


def run(spark, rows, **options):
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, n int, component_id string".replace("n int", "n string"))
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(df, **options).collect()}


@pytest.mark.parametrize("k,num,den", [(4, 85, 100), (5, 80, 100), (1, 60, 100)])
def test_equals_brute_force(spark, k, num, den):
    rows = texts(k)
    assert run(spark, rows, k=k, num=num, den=den) == brute(rows, k, num, den)


def test_large_group_with_stragglers(spark, monkeypatch):
    """Long lists, split keys, several blocks: no link is lost."""
    monkeypatch.setattr(linking, "SHORT", 2)
    monkeypatch.setattr(linking, "BLOCK", 40)
    monkeypatch.setattr(jaccard, "SALT", 16)
    rows = texts(7, groups=2, each=120, words=(60, 80), edits=6)
    want = brute(rows, 4, 85, 100)
    assert 5 < len({c for _, c in want.values()}) < 200
    assert run(spark, rows, k=4, num=85, den=100) == want


def test_edge_cases(spark):
    long = " ".join(f"a{k}" for k in range(30000))
    rows = [(1, None), (2, ""), (3, "  \t"), (4, "One two"), (5, "one TWO"), (6, long), (7, long + " x"), (None, "one two"), (8, "é É"), (4, "One two")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(df, k=4, num=85, den=100).collect()), key=str)
    assert got == sorted([(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (6, 29997, 6), (7, 29998, 6), (None, 1, 4), (8, 1, 8), (4, 1, 4)], key=str)
    assert jaccard.jaccard_components(df.limit(0)).collect() == []


def test_keys_never_miss():
    rng = np.random.default_rng(1)
    for _ in range(400):
        n = int(rng.integers(2, 40))
        a = np.sort(rng.choice(10**6, n, replace=False)).astype(np.uint64)
        b = np.sort(np.unique(np.concatenate([rng.choice(a, n - int(rng.integers(0, 3)), replace=False), rng.integers(0, 10**6, int(rng.integers(0, 3))).astype(np.uint64)]))) if n > 3 else a
        o = len(np.intersect1d(a, b))
        if 100 * o >= 85 * (len(a) + len(b) - o):
            for light in (0, 10, 64):
                one, two = (jaccard.keys_of(x, (x % np.uint64(7)).astype(np.int64), light, 85, 100)[0] for x in (a, b))
                assert len(np.intersect1d(one, two))


def test_connected(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1040)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    linked = {x for a, b in edges if a != b for x in (a, b)}
    got = connected(Scratch(spark, "t"), spark.createDataFrame(edges, "u long, v long")).collect()
    assert {r["id"]: r["root"] for r in got} == {x: find(x) for x in linked} and len(got) == len(linked)
