"""The n-gram Jaccard join against all pairs."""
import random

import pytest

import brute
from tramline.llm import near


def shingles(text):
    w = [x.translate(brute.LOWER) for x in brute.words(text)]
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def expected(rows, similarity=0.8):
    """{doc: (class, links, same)} by comparing all pairs; rows without words stand alone."""
    sets = {}
    for d, t in rows:
        sets.setdefault(shingles(t), []).append(d)
    own = [s for s in sets if s]
    parent = {s: s for s in own}

    def find(s):
        while parent[s] is not s:
            s = parent[s]
        return s

    links = dict.fromkeys(own, 0)
    for i, a in enumerate(own):
        for b in own[:i]:
            if len(a & b) >= similarity * len(a | b) - 1e-9:
                links[a] += 1
                links[b] += 1
                parent[find(a)] = find(b)
    least = {}
    for s in own:
        ids = [d for d in sets[s] if d is not None]
        least[find(s)] = min([*ids, *([least[find(s)]] if least.get(find(s)) is not None else [])], default=least.get(find(s)))
    return sorted(((d, least[find(s)], links[s], len(sets[s])) if (s := shingles(t)) else (d, d, 0, 1) for d, t in rows), key=lambda r: (r[0] is None, str(r)))


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(1)
    vocabulary = [f"w{i}" for i in range(400)] + ["É", "中"]
    passage = rnd.choices(vocabulary, k=30)
    out = []
    for k in range(60):
        text = rnd.choices(vocabulary, k=rnd.choice([3, 8, 60, 150]))
        if k % 3 == 0:
            text = passage + text[:20]
        for _ in range(rnd.choice([1, 1, 2, 5])):
            own = list(text)
            for _ in range(rnd.choice([0, 0, 1, 2])):
                own[rnd.randrange(len(own))] = rnd.choice(vocabulary)
            out.append((len(out), rnd.choice([" ", "\n", "  "]).join(own)))
    star = rnd.choices(vocabulary, k=200)
    for _ in range(90):
        own = list(star)
        for _ in range(rnd.randint(0, 6)):
            own[rnd.randrange(len(own))] = rnd.choice(vocabulary)
        out.append((len(out), " ".join(own)))
    long = rnd.choices(vocabulary, k=30000)
    return out + [(900, None), (901, ""), (902, " \n"), (903, None), out[5], out[5], (None, out[7][1]), (904, " ".join(long)), (905, " ".join(long[:-3]).upper().replace("W", "w"))]


def got(df):
    return sorted((tuple(r[c] for c in ("doc_id", "class_id", "n_links", "n_same")) for r in df.collect()), key=lambda r: (r[0] is None, str(r)))


def test_all_links(spark, rows):
    docs = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, node string")
    assert got(near.near_duplicates(docs)) == expected(rows)


def test_splits_and_blocks(spark, rows, monkeypatch):
    monkeypatch.setattr(near, "LIMIT", 6)
    monkeypatch.setattr(near, "BLOCK", 10)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(near.near_duplicates(docs)) == expected(rows)


def test_no_rows(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert near.near_duplicates(docs.limit(0)).count() == 0
    assert got(near.near_duplicates(docs.where("doc_id IN (900, 901)"))) == [(900, 900, 0, 1), (901, 901, 0, 1)]


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)]
    out = near.components(spark.createDataFrame(edges, "u long, v long"))
    assert {(r.node, r.label) for r in out.collect()} == {(i, 0) for i in range(1, 41)} | {(101, 100)}


def test_runs():
    assert near.runs_for(0.8) == 8


def test_low_similarity(spark, rows):
    """More runs than a signature of fixed width has coordinates."""
    some = rows[:60] + rows[-9:-2]
    docs = spark.createDataFrame(some, "doc_id long, text string")
    assert near.runs_for(0.4) > 60
    assert got(near.near_duplicates(docs, 0.4)) == expected(some, 0.4)


def test_shared_counts_in_slices():
    import numpy as np

    rnd = random.Random(3)
    lists = [np.array(sorted(rnd.sample(range(300), rnd.randint(0, 60))), np.uint64) for _ in range(20)]
    wanted = [[len(np.intersect1d(a, b)) for b in lists] for a in lists]
    for most in (1, 400, 1 << 20):
        out = near.shared_counts(lists, most)
        assert all(out[i][j] == wanted[i][j] for i in range(20) for j in range(20) if i != j)
