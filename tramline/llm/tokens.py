"""Token counts through a cache keyed by digests of the normalised content and of the tokenizer.

Defined results: a null text counts as empty (0 tokens); repeated rows and equal texts are encoded once; an empty table adds nothing
to the cache; a very long text is encoded whole by one task. Extra columns of the input are not read.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACE, read_text, remove_at_exit, row_keys, shared_dir, stored, write_text
from .kernels import text_pieces

#: Words whose counts a worker remembers before it starts afresh.
REMEMBERED = 1_000_000

_loaded: dict[str, tuple[Callable[[list[str]], list[int]], dict[str, int]]] = {}


def tokenizer_version(path: str) -> str:
    """A digest of the vocabulary file and the library that reads it: counts of another version are never reused."""
    if path.endswith(".model"):
        import sentencepiece as library
    else:
        import tokenizers as library
    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + library.__version__.encode()).hexdigest()


def splits_at_space(path: str) -> bool:
    """Whether ASCII white space only separates: the tokenizer normalises runs of it and drops it, so no token spans or holds it."""
    if path.endswith(".model"):
        return False
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    steps = [x.get("type") for x in (spec.get("normalizer") or {}).get("normalizers", [])]
    splits = [(x.get("type"), x.get("behavior"), x.get("invert")) for x in (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])]
    pattern = next((x["pattern"].get("Regex", "") for x in (spec.get("pre_tokenizer") or {}).get("pretokenizers", []) if x.get("type") == "Split"), " ")
    plain = not any(x["lstrip"] or x["rstrip"] or x["single_word"] or " " in x["content"] for x in spec.get("added_tokens", []))
    return plain and "Replace" in steps and set(steps) <= {"NFC", "Replace", "Lowercase"} and splits[:1] == [("Split", "Removed", True)] and r"[^\s" in pattern and " " not in pattern


def encoder(path: str) -> Callable[[list[str]], list[int]]:
    """A function that counts the tokens of each text as the library gives them: no added begin, end or special tokens."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.no_truncation()
    model.no_padding()
    return lambda texts: [len(x.ids) for x in model.encode_batch_fast(texts, add_special_tokens=False)]


def count_tokens(texts: list[str], path: str, by_word: bool) -> list[int]:
    """Tokens of each text. by_word: each distinct word between white space is encoded once and its count remembered."""
    if path not in _loaded:
        _loaded[path] = (encoder(path), {})
    encode, known = _loaded[path]
    if not by_word:
        return encode(texts)
    words = [x.encode().split() for x in texts]
    if len(known) > REMEMBERED:
        known.clear()
    new = list({w for own in words for w in own if w not in known})
    for at in range(0, len(new), 4096):
        part = new[at : at + 4096]
        known.update(zip(part, encode([w.decode() for w in part])))
    return [sum(map(known.__getitem__, own)) for own in words]


def normal_content(text_col: str, by_word: bool) -> Column:
    """The content that decides the count: runs of ASCII white space are alike to a tokenizer that splits there."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return F.regexp_replace(text, f"[{SPACE}]+", " ") if by_word else text


#: Batches of a version before they are compacted into one.
BATCHES = 16
CACHE_SCHEMA = T.StructType([T.StructField("digest", T.BinaryType()), T.StructField("n_tokens", T.LongType())])


def batches_of(spark: SparkSession, cache: str, version: str) -> list[str]:
    """The folders of a version's batches that were written whole, but for those that a compacted one replaces."""
    folder = f"{cache}/version={version}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    names = sorted(s.getPath().getName() for s in fs.listStatus(path))
    replaced = {x for n in names if n.startswith("replaced-") for x in json.loads(read_text(spark, f"{folder}/{n}"))}
    return [f"{folder}/{n}" for n in names if n.startswith("batch-") and n not in replaced and read_text(spark, f"{folder}/{n}/_SUCCESS") is not None]


def read_cache(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """(digest, n_tokens) of one tokenizer version, each digest once; a batch that was appended twice counts once."""
    folders = batches_of(spark, cache, version)
    if not folders:
        return spark.createDataFrame([], CACHE_SCHEMA)
    rows = spark.read.schema(CACHE_SCHEMA).parquet(*folders)
    return rows if len(folders) == 1 else rows.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def append_to_cache(rows: DataFrame, cache: str, version: str) -> DataFrame:
    """Writes a batch, and returns it read back."""
    to = f"{cache}/version={version}/batch-{uuid.uuid4().hex}"
    rows.write.parquet(to)
    return rows.sparkSession.read.schema(CACHE_SCHEMA).parquet(to)


def compact_cache(spark: SparkSession, cache: str, version: str) -> None:
    """More than BATCHES batches become one, in ranges of digests. The old ones are read no more, and go when the session ends: a result may still need them."""
    old = batches_of(spark, cache, version)
    if len(old) <= BATCHES:
        return
    folder, name = f"{cache}/version={version}", uuid.uuid4().hex
    read_cache(spark, cache, version).repartitionByRange("digest").sortWithinPartitions("digest").write.parquet(f"{folder}/batch-{name}")
    write_text(spark, f"{folder}/replaced-{name}.json", json.dumps([f.rsplit("/", 1)[1] for f in old]))
    for f in old:
        remove_at_exit(spark, f)


def token_counts(docs: DataFrame, path: str, cache: str | None = None, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns id, n_bytes, n_tokens and over_limit (n_tokens > limit) of every row.

    Contents are named by SHA-256. All digests are joined to the counts stored for this tokenizer version; those that it lacks are
    encoded, one row each, and appended as a batch, which their rows are joined to. Only one row of equal contents travels: its place is
    found from digests and ids alone, and the texts are dealt by both, so that many copies of one text do not meet in a task.
    A batch that was not written whole is not read, and a digest appended twice is counted once.
    """
    spark = docs.sparkSession
    cache = cache or f"{shared_dir(spark)}/token-counts"
    version = tokenizer_version(path)
    by_word = splits_at_space(path)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    k1, k2 = row_keys("id")
    keys = stored(rows.select(F.col("id"), F.octet_length("text").cast("long").alias("n_bytes"), F.unhex(F.sha2(normal_content("text", by_word), 256)).alias("digest"), k1, k2), "content-digests")
    compact_cache(spark, cache, version)
    stored_counts = read_cache(spark, cache, version)
    looked = keys.join(stored_counts, "digest", "left") if batches_of(spark, cache, version) else keys.withColumn("n_tokens", F.lit(None).cast("long"))
    wanted = looked.where("n_tokens IS NULL").groupBy("digest").agg(F.min_by("k2", "k1").alias("k2"), F.min("k1").alias("k1"))
    texts = rows.select(k1, k2, "text").join(wanted.hint("shuffle_hash"), ["k1", "k2"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()  # rows alike in id and text arrive together
        for batch in batches:
            fresh = []
            for digest in batch.column(0).to_pylist():
                fresh.append(digest not in seen)
                seen.add(digest)
            for part, _, _ in text_pieces(batch.filter(pa.array(fresh, pa.bool_()))):
                counts = count_tokens(part.column(1).to_pylist(), path, by_word)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64())], names=CACHE_SCHEMA.names)

    fresh = append_to_cache(texts.select("digest", "text").mapInArrow(run, CACHE_SCHEMA), cache, version)
    fresh = fresh.groupBy("digest").agg(F.max("n_tokens").alias("fresh"))
    out = looked.join(fresh, "digest", "left").withColumn("n_tokens", F.coalesce("n_tokens", "fresh"))
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
