"""Decontamination, line dedup, mixing and token counts against plain Python."""
import random
from collections import defaultdict

import public_tokenizers
import pytest
from pyspark.sql import types as T
from tokenizers import Tokenizer

import brute
from tramline.llm.decontaminate import decontaminate
from tramline.llm.line_dedup import FANOUT, LineRuns, dedup_lines
from tramline.llm.mixing import mix_sources
from tramline.llm.tokens import batches_of, read_cache, token_counts, tokenizer_version

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("source", T.StringType()), T.StructField("k1", T.StringType()), T.StructField("size", T.StringType())])


def frame(spark, rows):
    return spark.createDataFrame([(d, t, s, "x", "y") for d, t, s in rows], DOCS)


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(5)
    vocabulary = ["Alpha", "beta", "été", "naïve", "x1", "ΣΑΣ", "中文字", "the", "of", "don't", "a-b", "ﬁn", "İ", "<|endoftext|>"]
    lines = [" ".join(rnd.choices(vocabulary, k=rnd.randint(0, 12))) for _ in range(60)]
    out = []
    for d in range(150):
        own = [rnd.choice(lines) if rnd.random() < 0.7 else " ".join(rnd.choices(vocabulary, k=30)) for _ in range(rnd.randint(1, 8))]
        out.append((d, rnd.choice(["\n", " \n\t", "\r\n"]).join(own), rnd.choice(["a", "b", "c", "é", None])))
    long = " ".join(rnd.choices(vocabulary, k=40000))
    return out + [(900, None, "a"), (901, "", None), (902, "\n\n", "b"), (None, "beta of", "c"), (903, long, "a"), (904, long, "b"), out[3], out[3], (905, " \t ", "zero")]


def got(df, *columns):
    key = lambda r: tuple((x is not None, x) for x in r)
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=key)


def same(a, b):
    key = lambda r: tuple((x is not None, x) for x in r)
    assert a == sorted(b, key=key)


def test_decontaminate(spark, rows):
    items = [(1, "alpha beta the of x1 été"), (2, rows[903 - 900 + 150 - 3][1] if False else " ".join(rows[20][1].split()[:14])), (3, None), (4, "!!"), (5, " ".join(rows[20][1].split()[3:17])), (10, rows[30][1])]
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, n_words int")
    docs = frame(spark, rows)
    out = decontaminate(docs, bench, spans=True)
    names = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    same(got(out, *names), brute.decontaminate([(d, t) for d, t, _ in rows], items))
    texts = {d: t for d, t, _ in rows if d is not None}
    for r in out.where("n_hit > 0 AND doc_id IS NOT NULL").collect():
        raw = texts[r["doc_id"]].encode()
        spans = [raw[s["start"] : s["end"]].decode() for s in r["spans"]]
        assert sum(x[1] for x in brute.decontaminate([(0, s) for s in spans], items)) == r["n_hit"]
    assert decontaminate(docs.limit(0), bench).count() == 0
    assert decontaminate(docs, bench.limit(0)).where("n_hit > 0").count() == 0


def test_benchmark_beyond_the_automaton(spark, rows):
    bench = spark.createDataFrame([(i, rows[i][1]) for i in range(20, 40)] + [(50, "beta"), (51, "alpha beta the"), (None, rows[3][1])], "item_id long, text string")
    names = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans", "kept_source")
    whole = got(decontaminate(frame(spark, rows), bench, spans=True, keep=("source",)), *names)
    assert got(decontaminate(frame(spark, rows), bench, spans=True, keep=("source",), most_nodes=0), *names) == whole
    assert sum(r[2] > 0 for r in whole) > 20


def test_dedup_lines(spark, rows):
    from pyspark.sql import functions as F

    docs = frame(spark, rows)
    out = dedup_lines(docs).withColumn("sha", F.sha2(F.coalesce("kept", F.lit("")), 256))
    expected = brute.dedup_lines([(d, t) for d, t, _ in rows])
    assert sum(r[2] for r in expected) > 50
    same(got(out, "doc_id", "n_lines", "n_dropped", "sha"), expected)
    assert dedup_lines(docs.limit(0)).count() == 0


def test_dedup_lines_by_salted_join(spark, rows, monkeypatch):
    from tramline.llm import line_dedup

    docs = frame(spark, rows)
    names = ("doc_id", "n_lines", "n_dropped", "kept")
    whole = got(dedup_lines(docs), *names)
    monkeypatch.setattr(line_dedup, "SENT", 0)
    assert got(dedup_lines(docs, batches=5), *names) == whole


BATCH = "h1 long, h2 long, n long"


def test_runs_are_levelled_and_compacted(spark):
    runs = LineRuns(spark, min_docs=5)
    for k in range(2 * FANOUT + 1):
        runs.add(spark.createDataFrame([(1, 1, 1), (k, 5, 2), (9, 9, 5)], BATCH))
        assert (1, 1) not in {(r.h1, r.h2) for r in runs.often().collect()} or k >= 4
    assert [len(x) for x in runs.levels] == [1, 2]
    assert sorted((r.h1, r.h2) for r in runs.often().collect()) == [(1, 1), (9, 9)]
    assert {(r.h1, r.h2) for r in runs.new_in(spark.createDataFrame([(1, 1, 1), (77, 1, 1)], BATCH)).collect()} == {(77, 1)}
    again = LineRuns(spark, runs.path, min_docs=5)
    assert again.levels == runs.levels and again.often().count() == 2
    again.add(spark.createDataFrame([(3, 5, 3)], BATCH))
    assert again.often().count() == 3
    with pytest.raises(ValueError, match="counts up to 5"):
        LineRuns(spark, runs.path, min_docs=6)


def test_anti_join_decides(spark, monkeypatch):
    """Without it, a hash that is often already is counted anew and stands in several runs."""
    batch = spark.createDataFrame([(1, 1, 9)], BATCH)
    monkeypatch.setattr(LineRuns, "new_in", lambda self, counts: counts)
    runs = LineRuns(spark, min_docs=5)
    for _ in range(2):
        runs.add(batch)
    assert runs.often().count() == 2


def test_store_of_earlier_documents(spark, rows):
    """Two halves through one store drop in the second half what both halves hold often enough."""
    store = LineRuns(spark)
    first, second = rows[:100], rows[100:]
    dedup_lines(frame(spark, first), store=store).count()
    out = got(dedup_lines(frame(spark, second), store=store), "doc_id", "n_lines", "n_dropped")
    every = [(d, n, x) for d, n, x, _ in brute.dedup_lines([(d, t) for d, t, _ in rows])]
    same(out, every[100:])


def test_mixing(spark, rows):
    docs = frame(spark, rows)
    out = mix_sources(docs).collect()
    assert len(out) == len(rows)
    sizes, taken, target, n = defaultdict(int), defaultdict(int), {}, {}
    for d, t, s in rows:
        sizes[s] += len(brute.words(t))
    by_doc = {d: s for d, t, s in rows if d is not None}
    for r in out:
        s = by_doc.get(r["doc_id"], "c")
        assert r["source_size"] == sizes[s] and r["taken"] <= 3 * r["size"] and r["taken"] == r["repeats"] * r["size"]
        taken[s] += r["taken"]
        target[s] = r["target"]
        n[s] = max(n.get(s, 0), r["size"])
    expected = brute.water_fill(dict(sizes))
    for s in sizes:
        assert target[s] == pytest.approx(expected[s])
        assert abs(taken[s] - target[s]) <= n[s]
    again = mix_sources(docs.repartition(5)).collect()
    key = lambda r: (r["doc_id"] is None, r["doc_id"], r["taken"])
    assert sorted(out, key=key) == sorted(again, key=key)
    assert mix_sources(docs.limit(0)).count() == 0
    assert mix_sources(docs.where("doc_id IN (900, 901)")).agg({"taken": "sum"}).first()[0] == 0


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_token_counts(spark, rows, name, tmp_path):
    path, cache = public_tokenizers.path(name), f"file://{tmp_path}/cache"
    docs = frame(spark, rows)
    odd = [(2000 + i, t, "a") for i, t in enumerate(["a\x0bb", "a\x85b c", "a b", "<|endoftext|> x", "x<|endoftext|>\n\ny", "ǅ ΑΣ", "é ́ x", " ́", "a" * 5000, "\x00 b\x1cc\x1fd", "İ I ß ẞ"])]
    rows = rows + odd
    docs = frame(spark, rows)
    out = got(token_counts(docs, path, cache, limit=50), "doc_id", "n_bytes", "n_tokens", "over_limit")
    if name.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        count = lambda t: len(model.encode(t))
    else:
        model = Tokenizer.from_file(path)
        count = lambda t: len(model.encode(t, add_special_tokens=False).ids)
    same(out, [(d, len((t or "").encode()), n := count(t or ""), n > 50) for d, t, _ in rows])
    version = tokenizer_version(path)
    entries = read_cache(spark, cache, version).count()
    assert entries <= len({t or "" for _, t, _ in rows})
    assert got(token_counts(docs, path, cache, limit=50), "doc_id", "n_bytes", "n_tokens", "over_limit") == out
    assert read_cache(spark, cache, version).count() == entries
    assert token_counts(docs.limit(0), path, cache).count() == 0


def test_only_misses_are_encoded(spark, rows, tmp_path, monkeypatch):
    from tramline.llm import tokens

    path, cache = public_tokenizers.path("word_bpe_49k.json"), f"file://{tmp_path}/cache"
    version = tokenizer_version(path)
    monkeypatch.setattr(tokens, "BATCHES", 2)
    written = []
    append = tokens.append_to_cache
    monkeypatch.setattr(tokens, "append_to_cache", lambda *a: written.append(append(*a)) or written[-1])
    parts = [rows[:50], rows[:80], rows[40:], rows]
    for part in parts:
        token_counts(frame(spark, part), path, cache).count()
    # A count in the cache is taken as it is: the tokenizer is not asked again.
    assert [x.count() > 0 for x in written] == [True, True, True, False]
    assert len(batches_of(spark, cache, version)) == 2
    cold = got(token_counts(frame(spark, rows), path, f"{cache}-2"), "doc_id", "n_tokens")
    assert got(token_counts(frame(spark, rows), path, cache), "doc_id", "n_tokens") == cold
