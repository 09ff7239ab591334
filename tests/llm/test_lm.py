"""PPM scores against a dictionary version, and held-out accuracy."""
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import brute
from tramline.llm import lm


def ppm(train, order):
    seen = defaultdict(Counter)
    for raw in train:
        s = [0] * order + [b + 1 for b in raw] + [lm.END]
        for i in range(order, len(s)):
            for k in range(order + 1):
                seen[tuple(s[i - k : i])][s[i]] += 1

    def chance(context, symbol):
        p, excluded = 1.0, set()
        for k in range(len(context), -1, -1):
            own = {c: n for c, n in seen.get(tuple(context[len(context) - k :]), {}).items() if c not in excluded}
            total = sum(own.values()) + len(own)
            if symbol in own:
                return p * own[symbol] / total
            if own:
                p *= len(own) / total
            excluded |= set(own)
        return p / (lm.SYMBOLS - len(excluded))

    def score(raw):
        s = [0] * order + [b + 1 for b in raw] + [lm.END]
        return sum(math.log10(chance(s[i - order : i], s[i])) for i in range(order, len(s)))

    return score, chance


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(6)
    parts = ["the", "an", "er", "ing", "é", "of", "to"]
    word = lambda: "".join(rnd.choices(parts, k=rnd.randint(1, 3)))
    out = [(d, " ".join(rnd.choice([word(), word().upper(), "the"]) for _ in range(rnd.randint(1, 60)))) for d in range(120)]
    return out + [(900, None), (901, ""), (902, "\x00\x7f ~~ 中文 zzzq"), (None, "the end"), out[3], out[3], (903, " \n")]


def expected(rows, order):
    held = {d: zlib.crc32(("" if d is None else str(d)).encode()) % 5 == 1 for d, _ in rows}
    train = [t or "" for d, t in rows if not held[d]]
    token = lambda t: [w.translate(brute.LOWER) for w in brute.words(t)] + [None]
    c = Counter(w for t in train for w in token(t))
    n, v = sum(c.values()), len(c)
    score, _ = ppm([t.encode() for t in train], order)
    for d, t in rows:
        own = token(t)
        yield d, held[d], len(own), sum(c[w] > 0 for w in own), n, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own), score((t or "").encode())


@pytest.mark.parametrize("order,head", [(3, 10), (4, 10**6)])
def test_scores(spark, rows, order, head):
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, n int, row int")
    key = lambda r: (r[0] is None, str(r[0]), r[2])
    names = ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    got = sorted((tuple(r[c] for c in names) for r in lm.lm_scores(docs, order=order, head=head).collect()), key=key)
    for a, b in zip(got, sorted(expected(rows, order), key=key), strict=True):
        assert a[:5] == b[:5]
        assert a[5:] == pytest.approx(b[5:], rel=1e-9)


@pytest.mark.parametrize("nodes", [0, 40])
def test_grams_beyond_the_head_count(spark, rows, nodes):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    key = lambda r: (r[0] is None, str(r[0]), r[1])
    got = sorted(((r["doc_id"], r["n_tokens"], r["score"]) for r in lm.lm_scores(docs, nodes=nodes).collect()), key=key)
    for a, b in zip(got, sorted(((r[0], r[2], r[6]) for r in expected(rows, lm.ORDER)), key=key), strict=True):
        assert a[:2] == b[:2] and a[2] == pytest.approx(b[2], rel=1e-9)


def trained(texts, order=lm.ORDER, least=1):
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    packed, _ = lm.grams(data, np.concatenate([[0], np.cumsum([len(x) for x in raw])]), order)
    by_order = []
    for k in range(order + 1):
        keys, n = np.unique(packed & ((1 << lm.BITS * (k + 1)) - 1), return_counts=True)
        by_order.append((keys[n >= least], n[n >= least]))
    return lm.Trie.of(by_order)


@pytest.mark.parametrize("least", [1, 3])
def test_chances_sum_to_one(rows, least):
    trie = trained([t for _, t in rows if t], least=least)
    for context in ([0, 0, 0, 0], [0, 0, ord("t") + 1, ord("h") + 1], [ord(c) + 1 for c in "zzzz"], [ord(c) + 1 for c in "an e"], [ord(c) + 1 for c in "zthe"]):
        packed = 0
        for s in context:
            packed = packed << lm.BITS | s
        every = (packed << lm.BITS) | np.arange(1, lm.END + 1)
        assert (10 ** trie.log10(every)).sum() == pytest.approx(1)


def test_held_out_text_is_told_from_noise(spark, rows):
    text = [t for _, t in rows if t and len(t) > 80]
    trie = trained(text[: len(text) // 2])
    rnd = random.Random(1)

    def bits(t):
        raw = t.encode()
        packed, _ = lm.grams(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        return -trie.log10(packed).sum() * math.log2(10) / (len(raw) + 1)

    held = [bits(t) for t in text[len(text) // 2 :]]
    noise = [bits("".join(rnd.sample(t, len(t)))) for t in text[len(text) // 2 :]]
    assert np.mean(held) < 3 and min(noise) > max(held)


def test_no_rows(spark):
    assert lm.lm_scores(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    one = lm.lm_scores(spark.createDataFrame([(5, "a b")], "doc_id long, text string")).collect()
    assert len(one) == 1


def test_bounds(spark):
    counts = spark.createDataFrame([(i, n) for i, n in enumerate([9, 5, 5, 2, 1, 1, 1])], "key long, n long")
    assert [lm.least_count(counts, k) for k in (10, 7, 6, 4, 3, 2, 1)] == [1, 1, 2, 2, 5, 9, 9]
