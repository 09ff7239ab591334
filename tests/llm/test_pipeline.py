"""Each stage of the pipeline against plain Python, on what its predecessor kept."""
import random

import pytest

import brute
import corpus_pipeline as pipeline
from test_native import base
from test_near import expected as classes


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rnd = random.Random(12)
    vocabulary = ["".join(rnd.choices(["tha", "no", "in", "ber", "re", "ou", "é"], k=rnd.randint(1, 4))) for _ in range(500)]
    sentence = lambda n: " ".join(rnd.choices(vocabulary, k=n))
    items = [(i, sentence(14)) for i in range(12)]
    rows = []
    for d in range(260):
        text = "\n".join(sentence(rnd.randint(4, 30)) for _ in range(rnd.randint(2, 8)))
        if d % 5 == 0:
            text += "\nAll rights reserved. " + "\n"
        if d % 13 == 0:
            text = " ".join(x + "%%%" for x in text.split())
        if d % 9 == 0:
            text += "\n" + items[d % 12][1]
        rows.append((d, text, rnd.choice(["en", "de"]), rnd.choice(["a", "b", "c", None])))
        if d % 6 == 0:
            words = text.split(" ")
            words[len(words) // 2] = "changed"
            rows.append((1000 + d, " ".join(words), "en", "a"))
    rows += [(2000, None, "en", "a"), (2001, "", None, None), rows[7], (None, rows[8][1], "en", "b")]
    to = tmp_path_factory.mktemp("tables")
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{to}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{to}/benchmark.parquet")
    return str(to), rows, items


def collected(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=lambda r: (r[0] is None, str(r)))


def test_stages(spark, folder):
    to, rows, items = folder
    docs = spark.read.parquet(f"{to}/documents.parquet")
    columns = docs.columns
    step = dict(pipeline.STAGES)

    kept = step["quality"](spark, docs, to)
    assert kept.columns == columns
    one = collected(kept)
    good = [(d, t) for d, t, _, _ in rows if not base(t)[5] and "%%%" not in t]
    assert one == sorted(good, key=lambda r: (r[0] is None, str(r)))

    lines = step["lines"](spark, kept, to)
    assert lines.columns == columns
    two = lines.collect()
    assert sorted(((r["doc_id"], brute.sha(r["text"])) for r in two), key=lambda r: (r[0] is None, str(r))) == sorted(((d, s) for d, _, _, s in brute.dedup_lines(one)), key=lambda r: (r[0] is None, str(r)))
    assert all(len(r["text"]) == r["n_chars"] for r in two)
    assert not any("rights reserved" in r["text"] for r in two)

    near = step["near_duplicates"](spark, lines, to)
    assert near.columns == columns
    three = collected(near)
    own = [(r["doc_id"], r["text"]) for r in two]
    assert sorted(d for d, _ in three) == sorted({c for _, c, _, _ in classes(own)})

    clean = step["decontamination"](spark, near, to)
    assert clean.columns == columns
    assert collected(clean) == sorted([(d, t) for (d, t), r in zip(three, brute.decontaminate(three, items)) if not r[3]], key=lambda r: (r[0] is None, str(r)))

    sources, sizes = {r["doc_id"]: r["source"] for r in clean.collect()}, {}
    for d, t in collected(clean):
        sizes[sources[d]] = sizes.get(sources[d], 0) + len(brute.words(t))
    taken = {}
    for r in step["mix"](spark, clean, to).collect():
        assert r["repeats"] > 0 and r["taken"] == r["repeats"] * r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    for s, target in brute.water_fill(sizes).items():
        assert abs(taken.get(s, 0) - target) <= 300


def test_whole_run(spark, folder):
    to, _, _ = folder
    first = sorted(tuple(r) for r in pipeline.run(spark, to).select("doc_id", "repeats", "taken").collect())
    assert first == sorted(tuple(r) for r in pipeline.run(spark, to).select("doc_id", "repeats", "taken").collect())


def test_extra_columns_of_clashing_names(spark, folder):
    """Nothing is lost or changed by columns that stages use themselves."""
    from pyspark.sql import functions as F

    to, _, _ = folder
    docs = spark.read.parquet(f"{to}/documents.parquet")
    names = ("k1", "k2", "label", "text2", "node", "id", "slice", "kept", "distance", "drop", "size", "taken")
    more = docs.select("*", *[F.lit(1).alias(c) for c in names])
    for name, stage in pipeline.STAGES:
        assert collected(stage(spark, more, to)) == collected(stage(spark, docs, to)), name


def test_no_documents(spark, folder, tmp_path):
    to, _, _ = folder
    spark.read.parquet(f"{to}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{to}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0


def test_quality_compiles(spark, folder):
    """Filters on the distance stay above its steps: pushed below, they become one expression that the driver plans at length and that does not compile."""
    to, rows, _ = folder
    spark.conf.set("spark.sql.codegen.fallback", "false")
    try:
        kept = collected(dict(pipeline.STAGES)["quality"](spark, spark.read.parquet(f"{to}/documents.parquet"), to))
    finally:
        spark.conf.unset("spark.sql.codegen.fallback")
    assert kept == sorted(((d, t) for d, t, _, _ in rows if not base(t)[5] and "%%%" not in t), key=lambda r: (r[0] is None, str(r)))
