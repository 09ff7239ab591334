"""Benchmark decontamination by one Aho-Corasick automaton over normalised benchmark windows.

The automaton reads word numbers in two digits, so that a window takes two nodes a word and no node has many ways on. Nodes are counted before the
benchmark goes to the tasks; a benchmark of more than MOST_NODES is met by a join on 128-bit hashes of its windows instead, with the same answers.

Defined results: a null or wordless text has no words and no hits; an item without words has no window; repeated rows are
answered alike; an item id that is null is left out; a repeated item id counts once; a very long text is one row, in memory some
hundred times its size. An empty benchmark leaves all clean. Extra columns are carried on by name (keep) or left out.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import row_keys
from .kernels import BASE, U, lowered, merged_runs, mix, powers, span_hashes, text_pieces, word_spans

#: Bytes outside [^\x00-\x2F\x3A-\x60\x7B-\x7F] once A-Z are lower case.
GAPS = np.ones(256, bool)
GAPS[list(range(0x30, 0x3A)) + list(range(0x61, 0x7B)) + list(range(0x80, 0x100))] = False
#: The same as an expression, over lower-case text.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Nodes up to which the benchmark is one automaton in each worker: a node takes some seventy bytes.
MOST_NODES = 2_000_000

_automata: dict[str, tuple] = {}


def normal_words(text: str | None) -> list[bytes]:
    data = lowered(np.frombuffer((text or "").encode(), np.uint8))
    starts, ends, _ = word_spans(data, np.array([0, len(data)]), GAPS)
    raw = data.tobytes()
    return [raw[s:e] for s, e in zip(starts.tolist(), ends.tolist())]


def windows_of(words: list, size: int) -> set[tuple]:
    """Each window of an item: size words in a row, or all of an item of fewer."""
    return {tuple(words)} if 0 < len(words) < size else {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if words else set()


#: First code points of the digits; a word that no item holds is two of UNKNOWN.
HIGH, LOW, UNKNOWN = 0x10000, 0x20000, "\x01\x01"
TABLE = bytes(32 if GAPS[b] else b for b in range(256))


def automaton(items: list[tuple[str, str]], size: int) -> tuple[ahocorasick.Automaton | None, dict[bytes, str]]:
    """The automaton, whose values are (words, items), and the two digits of each word."""
    own = [(item, normal_words(text)) for item, text in items]
    number = {w: i for i, w in enumerate(dict.fromkeys(w for _, words in own for w in words))}
    base = max(1, math.isqrt(len(number)) + 1)
    digits = {w: chr(HIGH + i // base) + chr(LOW + i % base) for w, i in number.items()}
    by_window: dict[str, set[str]] = {}
    for item, words in own:
        for w in windows_of([digits[x] for x in words], size):
            by_window.setdefault("".join(w), set()).add(item)
    if not by_window:
        return None, digits
    made = ahocorasick.Automaton()
    for w, found in by_window.items():
        made.add_word(w, (len(w) // 2, tuple(sorted(found))))
    made.make_automaton()
    return made, digits


def scan(low: np.ndarray, machine: ahocorasick.Automaton | None, digits: dict[bytes, str]) -> tuple[list[tuple[int, int]], set[str]]:
    """One pass over a lower-case text: windows found as (first word, words), and the items they are of."""
    if machine is None:
        return [], set()
    text = "".join([digits.get(w, UNKNOWN) for w in low.tobytes().translate(TABLE).split()])
    hits: list[tuple[int, int]] = []
    found: set[str] = set()
    if text:
        for end, (n, items) in machine.iter(text):
            hits.append((end // 2 - n + 1, n))
            found.update(items)
    return hits, found


def benchmark_items(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    return benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text")).where("item IS NOT NULL AND text IS NOT NULL").distinct()


def nodes(items: DataFrame, window: int) -> int:
    """The most nodes that an automaton over the items' windows can take."""
    words = F.regexp_count(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(WORD)).cast("long")
    own = F.when(words <= window, words).otherwise((words - window + 1) * window)
    return int(items.agg(F.sum(2 * own)).first()[0] or 0)


def window_hashes(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """128-bit hashes of the windows of size words of each text: (text, first word, h1, h2)."""
    low = lowered(data)
    starts, ends, firsts = word_spans(low, offsets, GAPS)
    count = np.maximum(np.diff(firsts) - size + 1, 0)
    text = np.repeat(np.arange(len(count)), count)
    place = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    at = firsts[:-1][text] + place
    found = []
    for salt in (0, 1):
        words = span_hashes(low, starts, ends, salt) if len(starts) else np.zeros(0, U)
        whole = np.zeros(len(at), U)
        for k, power in enumerate(powers(BASE, size + 1)[1:]):
            whole += words[at + k] * power
        found.append(mix(whole + U(size)))
    return text, place, *found


def joined_hits(rows: DataFrame, items: DataFrame, window: int) -> DataFrame:
    """(k1, k2, hits, items) of rows that hold a window, by a join on hashes. Items of fewer words have windows of their own sizes."""
    words = F.regexp_count(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(WORD))
    counted = items.withColumn("size", F.least(words, F.lit(window))).where("size > 0")
    sizes = [r["size"] for r in counted.select("size").distinct().collect()]  # at most window numbers

    def windows(df: DataFrame, kind: str) -> DataFrame:
        """df's leading columns but the text, and its windows."""
        names = [c for c in df.columns if c != "text"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part, data, offsets in text_pieces(batch):
                    for n in sizes:
                        text, place, h1, h2 = window_hashes(data, offsets, n)
                        if len(text):
                            own = [part.column(part.schema.get_field_index(c)).take(pa.array(text)) for c in names]
                            yield pa.RecordBatch.from_arrays([*own, pa.array(place.astype(np.int32)), pa.array(np.full(len(text), n, np.int32)), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64))], names=[*names, "i", "n", "h1", "h2"])

        return df.mapInArrow(run, f"{kind}, i int, n int, h1 long, h2 long")

    wanted = windows(counted.select("item", F.col("size").alias("own"), "text"), "item string, own int").where("n = own").select("item", "n", "h1", "h2").distinct()
    found = windows(rows.select("k1", "k2", "text"), "k1 long, k2 long").join(wanted, ["n", "h1", "h2"])
    return found.groupBy("k1", "k2").agg(F.collect_set(F.struct("i", "n")).alias("hits"), F.collect_set("item").alias("items"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 8, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", spans: bool = False, keep: tuple[str, ...] = (), most_nodes: int | None = None) -> DataFrame:
    """Marks each document with the benchmark windows found in it.

    Returns id, n_words, n_hit, n_items, items_sha256, contaminated (two items or more), the columns of keep as they are, and
    with spans the found stretches as (start, end) byte offsets in the original text. Up to most_nodes the benchmark goes to the tasks,
    each worker builds the automaton once and scans its texts once, and nothing is shuffled; beyond it windows are joined.
    """
    items = benchmark_items(benchmark, item_col, text_col)
    kept = [f for f in docs.schema.fields if f.name in keep]
    id_type = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, id_type), T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("n_items", T.LongType()), T.StructField("items_sha256", T.StringType()), T.StructField("contaminated", T.BooleanType())])
    if spans:
        schema.add("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])))
    for f in kept:
        schema.add(f"kept_{f.name}", f.dataType)
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *[F.col(f.name).alias(f"kept_{f.name}") for f in kept])
    automatic = nodes(items, window) <= (MOST_NODES if most_nodes is None else most_nodes)
    if automatic:
        own = [tuple(r) for r in items.orderBy("item", "text").collect()]
        token = hashlib.sha256(repr((own, window)).encode()).hexdigest()
        shared = docs.sparkSession.sparkContext.broadcast(own)
    else:
        rows = source.select("*", *row_keys("id"))
        found = joined_hits(rows, items, window)
        source = rows.join(found.hint("shuffle_hash"), ["k1", "k2"], "left").drop("k1", "k2").select("id", "text", "hits", "items", *[f"kept_{f.name}" for f in kept])
    first = 2 if automatic else 4

    def answers(batch: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[list[tuple[int, int]], set[str]]]:
        if not automatic:
            for hits, names in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                yield [(h["i"], h["n"]) for h in hits or []], set(names or [])
            return
        if token not in _automata:
            _automata.clear()
            _automata[token] = automaton(shared.value, window)
        low = lowered(data)
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            yield scan(low[a:b], *_automata[token])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in text_pieces(batch):
                starts, ends, firsts = word_spans(lowered(data), offsets, GAPS)
                out: dict[str, list] = {k: [] for k in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans")}
                for k, (hits, found) in enumerate(answers(rows, data, offsets)):
                    places = np.array(hits, np.int64).reshape(-1, 2)
                    a, b = merged_runs(places[:, 0], places[:, 0] + places[:, 1])
                    ids = sorted(found)
                    out["n_words"].append(int(firsts[k + 1] - firsts[k]))
                    out["n_hit"].append(int((b - a).sum()))
                    out["n_items"].append(len(ids))
                    out["items_sha256"].append(hashlib.sha256(",".join(ids).encode()).hexdigest())
                    out["contaminated"].append(len(ids) >= 2)
                    if spans:
                        at = int(firsts[k])
                        out["spans"].append([{"start": int(starts[at + i] - offsets[k]), "end": int(ends[at + j - 1] - offsets[k])} for i, j in zip(a.tolist(), b.tolist())])
                columns = [rows.column(0), *(pa.array(out[k], pa.int64()) for k in ("n_words", "n_hit", "n_items")), pa.array(out["items_sha256"], pa.string()), pa.array(out["contaminated"], pa.bool_())]
                if spans:
                    columns.append(pa.array(out["spans"], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))))
                columns += [rows.column(i) for i in range(first, rows.num_columns)]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return source.mapInArrow(run, schema)
