"""Substring dedup by content-defined chunks.

A gear rolling hash over the last 16 bytes cuts each text where it is greater than at the REACH places on either side, so that a
cut depends on the bytes near it only, two copies fall into step at once, and an insertion changes the chunks around it only. A stretch that
repeats one word is cut where the hash is as great as nearby, more than REACH bytes apart, into chunks alike. Chunks are named by digest. A chunk whose digest stands elsewhere is a repeat; runs of
repeats are removed where they are at least least bytes long or a whole text, but for each chunk's first place in the order of keys.

Defined results: a null or empty text has no chunks and nothing removed; rows alike in id and text are one document counted as often as it
stands, and answered alike: they keep the chunk's first place together; a very long text is one piece, in memory some fifty times its
size; an empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import row_keys, stored
from .kernels import U, merged_runs, mix, span_hashes, text_pieces

#: Places on either side of a cut where the hash must not be greater: chunks, but the last of a text, have more bytes than this, and 2 * REACH + 1 on average. MOST bytes without such a place are cut.
REACH, MOST = 24, 512
#: Bytes of repeated chunks in a row before they count as a repeated passage.
PASSAGE = 130
#: A digest is common that has more than one in this many of the repeated chunks.
OFTEN = 1024
GEAR = (mix(np.arange(1, 257, dtype=U)) >> U(32)).astype(np.uint32)


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """At each byte, the gear hash of the 16 bytes that end there: the sum of the bytes' gears, each shifted by twice its age."""
    h = GEAR[data]
    for k in (1, 2, 4, 8):
        h[k:] += h[:-k] << np.uint32(2 * k)
    return h


def greatest_ahead(x: np.ndarray, n: int) -> np.ndarray:
    """The greatest of x[i : i + n] for each i that has n values."""
    size = 1
    while 2 * size <= n:
        x = np.maximum(x[:-size], x[size:])
        size *= 2
    return np.maximum(x[: len(x) - n + size], x[n - size :])


def cuts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends of all chunks, and for each text how many it has. The first REACH bytes of a text end no chunk, so that no text sees its neighbours."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(len(offsets) - 1, np.int64)
    scores = np.zeros(len(data) + 2 * REACH, np.uint32)
    own = scores[REACH:-REACH]
    own[:] = gear_hashes(data) | np.uint32(1)
    for k in range(REACH):
        early = offsets[:-1] + k
        own[early[early < offsets[1:]]] = 0
    peaks = greatest_ahead(scores, REACH)
    before, level = peaks[: len(own)], (own >= peaks[REACH + 1 :]) & (own > 0)
    bounds = np.union1d(np.flatnonzero(level & (own > before)) + 1, offsets)
    ties = np.flatnonzero(level & (own == before)) + 1
    last, taken = 0, []
    for tie, bound in zip(ties.tolist(), bounds[np.searchsorted(bounds, ties) - 1].tolist()):
        if tie - max(last, bound) > REACH:
            taken.append(tie)
            last = tie
    bounds = np.union1d(bounds, np.array(taken, np.int64))
    bounds = bounds[bounds > 0]
    starts = np.concatenate([[0], bounds[:-1]])
    pieces = (bounds - starts + MOST - 1) // MOST
    nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces) + 1
    ends = np.minimum(np.repeat(starts, pieces) + nth * MOST, np.repeat(bounds, pieces)).astype(np.int64)
    return ends, np.diff(np.searchsorted(ends, offsets, "right"))


CHUNKS = "k1 long, k2 long, d1 long, d2 long, start int, length int, fresh boolean"


def chunk_rows(docs: DataFrame) -> DataFrame:
    """A row for each chunk of (k1, k2, text): its digest (d1, d2), start and length in bytes, and whether it is the first of its digest in its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in text_pieces(batch):
                ends, counts = cuts(data, offsets)
                if not len(ends):
                    continue
                text = np.repeat(np.arange(len(counts)), counts)
                starts = np.concatenate([[0], ends[:-1]])
                d1, d2 = (span_hashes(data, starts, ends, salt).view(np.int64) for salt in (1, 2))
                fresh = np.zeros(len(ends), bool)
                fresh[np.unique(mix(d1.view(U) + text.astype(U)), return_index=True)[1]] = True
                k1, k2 = (np.asarray(part.column(i))[text] for i in range(2))
                for at in range(0, len(ends), 20000):
                    s = slice(at, at + 20000)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (k1[s], k2[s], d1[s], d2[s], (starts - offsets[text])[s].astype(np.int32), (ends - starts)[s].astype(np.int32), fresh[s])], names=["k1", "k2", "d1", "d2", "start", "length", "fresh"])

    return docs.select("k1", "k2", "text").mapInArrow(run, CHUNKS)


def substring_dedup(docs: DataFrame, passage: int = PASSAGE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_bytes, n_chunks, n_repeated (bytes in repeated passages, the first places included), n_removed, n_spans, kept_sha256 and has_repeat.

    Only digests are shuffled to find repeats, counted where they are made before they are dealt out; chunks are cut once more to
    meet the counts, which takes less than keeping them would. Digests with more than one in OFTEN of all repeated chunks, so fewer than OFTEN, are
    broadcast, and their chunks are dealt out by place: no digest fills one task. Texts move once, to be rid of it; a chunk's copies in one text are told apart by their place.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).select("id", "text", *row_keys("id"))
    chunks = chunk_rows(rows)
    found = stored(chunks.groupBy("d1", "d2").agg(F.count("*").alias("n"), F.min("k1").alias("f1")).where("n > 1"), "chunks")
    total = found.agg(F.sum("n")).first()[0] or 0
    often = F.col("n") > total / OFTEN
    common = found.where(often).select("d1", "d2", F.col("f1").alias("common"))
    dealt = chunks.join(F.broadcast(common), ["d1", "d2"], "left").withColumn("d2", F.when(F.col("common").isNotNull(), F.xxhash64("k1", "start")).otherwise(F.col("d2")))
    met = dealt.join(found.where(~often).select("d1", "d2", "f1"), ["d1", "d2"], "left").withColumn("f1", F.coalesce("common", "f1")).where("f1 IS NOT NULL")
    places = met.select("k1", "k2", F.struct("start", "length", (F.col("fresh") & (F.col("k1") == F.col("f1"))).alias("first")).alias("c"))
    per_text = places.groupBy("k1", "k2").agg(F.collect_set("c").alias("repeats"))
    counts = rows.select("id", "text", "k1", "k2").join(per_text.hint("shuffle_hash"), ["k1", "k2"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "n_bytes", "n_chunks", "n_repeated", "n_removed", "n_spans", "kept_sha256", "has_repeat"]
        for batch in batches:
            for part, data, offsets in text_pieces(batch):
                _, n_chunks = cuts(data, offsets)
                raw = data.tobytes()
                out: list[list] = [[] for _ in range(5)]
                for k, repeats in enumerate(part.column(2).to_pylist()):
                    own = raw[offsets[k] : offsets[k + 1]]
                    held, s, e = repeated_spans(repeats or [], passage, len(own))
                    kept = b"".join(own[a:b] for a, b in zip([0, *e.tolist()], [*s.tolist(), len(own)]))
                    for x, v in zip(out, (held, len(own) - len(kept), len(s), hashlib.sha256(kept).hexdigest(), held > 0)):
                        x.append(v)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(offsets)), pa.array(n_chunks), *(pa.array(x, pa.int64()) for x in out[:3]), pa.array(out[3], pa.string()), pa.array(out[4], pa.bool_())], names=names)

    kind = rows.schema["id"].dataType.simpleString()
    out = counts.select("id", "text", "repeats").mapInArrow(run, f"id {kind}, n_bytes long, n_chunks long, n_repeated long, n_removed long, n_spans long, kept_sha256 string, has_repeat boolean")
    return out.withColumnRenamed("id", id_col)


def repeated_spans(repeats: list[dict], passage: int, size: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Bytes in passages of repeated chunks (a text of size bytes that is all repeated is one, however short), and the spans to remove: those passages without the chunks that stand there first."""
    if not repeats:
        return 0, np.zeros(0, np.int64), np.zeros(0, np.int64)
    repeats = sorted(repeats, key=lambda r: r["start"])
    s = np.array([r["start"] for r in repeats], np.int64)
    e = s + np.array([r["length"] for r in repeats], np.int64)
    first = np.array([r["first"] for r in repeats])
    a, b = merged_runs(s, e)
    long = (b - a >= passage) | (b - a == size)
    inside = long[np.searchsorted(a, s, "right") - 1]
    removed = merged_runs(s[inside & ~first], e[inside & ~first])
    return int((b - a)[long].sum()), *removed
