"""Suffix-array dedup against a dictionary of all windows."""
import random
from collections import Counter

import numpy as np
import pytest

import brute
from tramline.llm import kernels, suffixes


def covered(raw, length):
    """For each text, which bytes a repeated string of the length covers."""
    n = Counter(x[i : i + length] for x in raw for i in range(len(x) - length + 1))
    out = []
    for x in raw:
        gone = np.zeros(len(x) + 1, bool)
        for i in range(len(x) - length + 1):
            if n[x[i : i + length]] > 1:
                gone[i : i + length] = True
        out.append(gone)
    return out


def expected(rows, length, passage):
    raw = [(t or "").encode() for _, t in rows]
    out = []
    for (d, _), x, gone, short in zip(rows, raw, covered(raw, length), covered(raw, passage)):
        kept = bytes(b for b, g in zip(x, gone) if not g)
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((d, len(x), len(x) - len(kept), spans, brute.sha(kept), int(short.sum())))
    return sorted(out, key=lambda r: (r[0] is None, str(r)))


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choices("abcdé ", k=rnd.randint(1, 9)))
    passage = " ".join(word() for _ in range(160))
    out = []
    for d in range(80):
        own = " ".join(word() for _ in range(rnd.randint(1, 150)))
        if d % 3 == 0:
            a = rnd.randint(0, 200)
            own = own + passage[a : a + rnd.choice([290, 350, 390, 700])] + word()
        if d % 7 == 0:
            own = own[: len(own) // 2] + "*" + own[len(own) // 2 :]
        out.append((d, own))
        if d % 10 == 0:
            out.append((200 + d, own[:-3] + "zz"))
    return out + [(900, None), (901, ""), (902, "a" * 1500), (903, "ab" * 300 + "c"), (904, "\x00" * 700), (905, out[4][1]), out[6], out[6], (None, out[12][1]), (906, "中文" * 20000)]


def got(df):
    return sorted((tuple(r[c] for c in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_repeated")) for r in df.collect()), key=lambda r: (r[0] is None, str(r)))


def test_all_repeats(spark, rows):
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, k1 int")
    wanted = expected(rows, 400, 300)
    assert sum(r[2] > 0 for r in wanted) > 10 and sum(r[5] > r[2] for r in wanted) > 5
    assert got(suffixes.suffix_dedup(docs)) == wanted


def test_anchors_spread_over_shards(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(suffixes.suffix_dedup(docs, length=100, passage=60, shard=1500)) == expected(rows, 100, 60)


def test_long_texts_in_pieces(spark, rows):
    some = rows[:40] + rows[80:]
    docs = spark.createDataFrame(some, "doc_id long, text string")
    assert got(suffixes.suffix_dedup(docs, length=100, passage=60, piece=700)) == expected(some, 100, 60)


def test_hashes_in_stretches(monkeypatch):
    data = np.frombuffer(random.Random(1).randbytes(9000), np.uint8)
    starts = np.arange(0, 8000, 3)
    whole = kernels.span_hashes(data, starts, starts + 50, 2)
    monkeypatch.setattr(kernels, "PIECE", 100)
    assert (kernels.span_hashes(data, starts, starts + 50, 2) == whole).all()


def test_no_rows(spark):
    assert suffixes.suffix_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("seed", range(8))
def test_suffix_array_and_prefixes(seed):
    rnd = random.Random(seed)
    parts = [bytes(rnd.choices([0, 97, 98], k=rnd.choice([rnd.randint(1, 60), 8, 16, 32]))) for _ in range(rnd.randint(1, 12))]
    parts += parts[:1]
    data = np.frombuffer(b"".join(parts), np.uint8)
    sizes = np.array([len(p) for p in parts])
    ends = np.cumsum(sizes)
    sa, packed, left, deep = suffixes.suffix_array(data, ends, 30)
    # The end of a part sorts first, by part.
    suffix = lambda i: [b + 1000 for b in data[i : i + left[i]].tolist()] + [int(np.searchsorted(ends, i, "right"))]
    assert sa.tolist() == sorted(range(len(data)), key=suffix)
    shared = {}
    for chosen in (np.ones(len(data), bool), left > 5, deep):
        ranked, n = suffixes.common_prefixes(sa, packed, left, chosen, 1 << 20)
        assert ranked.tolist() == [i for i in sa.tolist() if chosen[i]]
        for a, b, k in zip(ranked[:-1].tolist(), ranked[1:].tolist(), n[1:].tolist()):
            x, y = suffix(a)[:-1], suffix(b)[:-1]
            assert k == next((k for k in range(min(len(x), len(y))) if x[k] != y[k]), min(len(x), len(y)))
            shared[a], shared[b] = (max(shared.get(i, 0), k) for i in (a, b))
    assert all(deep[i] for i, k in shared.items() if k >= 30)
