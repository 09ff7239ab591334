"""Content-defined chunks against a byte-by-byte version."""
import random
from collections import Counter

import pytest

import brute
from tramline.llm import chunks
from tramline.llm.common import row_keys


def chunk(raw):
    scores = []
    for i in range(len(raw)):
        h = 0
        for age in range(16):
            h += int(chunks.GEAR[raw[i - age]]) << (2 * age) if i >= age else 0
        scores.append((h & 0xFFFFFFFF) | 1 if i >= chunks.REACH else 0)
    out, at, last = [], 0, 0
    for i, x in enumerate(scores):
        before = max(scores[max(0, i - chunks.REACH) : i], default=0)
        level = x and x >= before and x >= max(scores[i + 1 : i + 1 + chunks.REACH], default=0)
        top = level and (x > before or i + 1 - last > chunks.REACH)
        last = i + 1 if top else last
        if top or i + 1 - at == chunks.MOST or i + 1 == len(raw):
            out.append(raw[at : i + 1])
            at = i + 1
    return out


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choices("abcdeé ", k=rnd.randint(2, 9)))
    passage = " ".join(word() for _ in range(90))
    out = []
    for d in range(60):
        own = " ".join(word() for _ in range(rnd.randint(1, 120)))
        if d % 4 == 0:
            own = own + " " + passage + " " + own[:50]
        if d % 9 == 0:
            own += passage
        out.append((d, own))
    return out + [(900, None), (901, ""), (902, "x" * 9000), (906, "spam word " * 300), (907, own[:99] + "spam word " * 60), (903, out[8][1]), (904, out[9][1]), (None, out[12][1]), (905, "中" * 70000 + passage)]


def test_chunks(spark, rows):
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, k1 int")
    out = {r["doc_id"]: r for r in chunks.substring_dedup(docs).collect()}
    own = {d: chunk((t or "").encode()) for d, t in rows}
    n = Counter(c for x in own.values() for c in x)
    key = {r["doc_id"]: r["key"] for r in docs.na.fill("").select("doc_id", row_keys()[0].alias("key")).collect()}
    first = {}
    for d in sorted(own, key=key.get):
        for i, c in enumerate(own[d]):
            first.setdefault(c, (d, i))
    for d, t in rows:
        r, raw = out[d], (t or "").encode()
        held, run, kept, spans, keep, dropping = 0, [], b"", 0, [], False
        for i, c in enumerate([*own[d], None]):
            if c is not None and n[c] > 1:
                run.append(i)
                continue
            size = sum(len(own[d][j]) for j in run)
            if run and (size >= chunks.PASSAGE or size == len(raw)):
                held += size
                keep += [(j, first[own[d][j]] == (d, j)) for j in run]
            run = []
        gone = {j for j, stays in keep if not stays}
        for i, c in enumerate(own[d]):
            spans += i in gone and not dropping
            dropping = i in gone
            kept += b"" if dropping else c
        assert (r["n_bytes"], r["n_chunks"], r["n_repeated"], r["has_repeat"]) == (len(raw), len(own[d]), held, held > 0)
        assert (r["n_removed"], r["n_spans"], r["kept_sha256"]) == (len(raw) - len(kept), spans, brute.sha(kept))
    assert out[903]["n_repeated"] == out[903]["n_bytes"]
    assert sum(out[d]["has_repeat"] for d in range(0, 60, 4)) == 15
    assert out[906]["n_removed"] > 2900 and out[907]["n_removed"] > 500
    assert sorted(out[d]["n_removed"] for d in (None, 12))[1] > 0


def test_passages_of_51_words(spark):
    rnd = random.Random(8)
    words = lambda n: " ".join("".join(rnd.choices("abcdefghilmnoprstu", k=rnd.randint(2, 8))) for _ in range(n))
    out = []
    for k in range(300):
        passage = words(51)
        out += [(3 * k, f"{words(40)} {passage} {words(40)}"), (3 * k + 1, f"{words(33)} {passage} {words(50)}"), (3 * k + 2, words(130))]
    got = {r["doc_id"]: r["has_repeat"] for r in chunks.substring_dedup(spark.createDataFrame(out, "doc_id long, text string")).collect()}
    assert sum(got[d] for d in got if d % 3 < 2) >= 0.95 * 600
    assert not any(got[d] for d in got if d % 3 == 2)


def test_insertions_shift_little():
    import numpy as np

    rnd = random.Random(4)
    raw = bytes(rnd.choices(range(97, 110), k=20000))
    shifted = raw[:5000] + b"inserted" + raw[5000:]
    a, b = set(chunk(raw)), set(chunk(shifted))
    assert len(a - b) <= 4
    ends, counts = chunks.cuts(np.frombuffer(raw + shifted, np.uint8), np.array([0, len(raw), len(raw) + len(shifted)]))
    lengths = np.diff(np.concatenate([[0], ends]))
    assert lengths[: counts[0]].tolist() == [len(c) for c in chunk(raw)] and lengths[counts[0] :].tolist() == [len(c) for c in chunk(shifted)]


def test_short_whole_copies(spark):
    texts = ["a short text", "a short text", "another one of more than a chunk: " + "abc def ghi " * 5, "another one of more than a chunk: " + "abc def ghi " * 5, "alone"]
    out = {r["doc_id"]: r for r in chunks.substring_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [out[k]["n_repeated"] for k in range(5)] == [len(t) for t in texts[:4]] + [0]
    assert [out[k]["has_repeat"] for k in range(5)] == [True] * 4 + [False]
    assert sorted(out[k]["n_removed"] for k in (0, 1)) == [0, len(texts[0])] and sorted(out[k]["n_removed"] for k in (2, 3))[1] == len(texts[2])


def test_no_rows(spark):
    assert chunks.substring_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0
