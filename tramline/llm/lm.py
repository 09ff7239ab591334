"""Language-model scores by prediction by partial matching (PPM), beside a unigram base.

Training texts are counted in one pass: every byte with the ORDER symbols before it, and every word. The context trie is held as sorted
tables of packed contexts, one for each order. A symbol's chance is that of the longest context that knows it; each
longer context charges its escape by method C (distinct symbols over total plus distinct), and the symbols it knows are excluded from
the shorter ones. Each document's score is the sum of log10 chances of its bytes and its end.

No count is left out. Chances of grams are found from all counts by joins on the cluster: those of the NODES most frequent go to the tasks as a lookup, the
others meet their grams by a join, and so do words beyond the HEAD most frequent. Grams that never trained go down the orders by joins with the contexts.

Defined results: a null text is empty and scores its end only; a null id counts as the empty string and trains; rows alike are scored
alike; without training texts all chances are uniform; a very long text is one piece, in memory some hundred times its size; an empty
table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored
from .kernels import BASE, U, lowered, span_hashes, text_pieces, word_spans

#: Symbols of context; bits of a packed symbol; 0 pads the start of a text, bytes are 1 to 256, END closes it.
ORDER, BITS, END = 4, 9, 257
SYMBOLS = 257
#: Bounds of what goes to the tasks: grams with their chances, and words with their counts.
NODES, HEAD = 2_000_000, 300_000
#: Bytes of text packed at once: each takes some dozen 64-bit numbers.
MODEL_PIECE = 1 << 19
#: The key that stands for a text's end among the words' hashes.
END_WORD = 1


def grams(data: np.ndarray, offsets: np.ndarray, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """Each symbol of each text packed with the order symbols before it, and where each text's begin: (grams, offsets)."""
    n = np.diff(offsets)
    texts = len(n)
    stride = offsets[:-1] + np.arange(texts) * (order + 1)
    symbols = np.zeros(int(offsets[-1]) + texts * (order + 1), np.int64)
    place = np.arange(int(offsets[-1])) + np.repeat(np.arange(texts) * (order + 1) + order, n)
    symbols[place] = data.astype(np.int64) + 1
    symbols[stride + n + order] = END
    packed = np.zeros(len(symbols) - order, np.int64)
    for j in range(order + 1):
        packed = (packed << BITS) | symbols[j : j + len(packed)]
    real = np.ones(len(packed), bool)
    pads = (stride[1:, None] + np.arange(-order, 0)[None, :] + 0).ravel()
    real[pads] = False
    return packed[real], np.concatenate([[0], np.cumsum(n + 1)])


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of each text with A-Z lowered: (hashes, offsets)."""
    low = lowered(data)
    starts, ends, firsts = word_spans(low, offsets)
    return span_hashes(low, starts, ends).view(np.int64), firsts


def summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with their counts added."""
    k, n = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k)
    k, n = k[order], n[order]
    at = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    return k[at], np.add.reduceat(n, at) if len(at) else n


class Table:
    """Open addressing from 64-bit keys to their numbers, looked up for many keys at once."""

    def __init__(self, keys: np.ndarray):
        values = np.arange(len(keys), dtype=np.int32)
        self.shift = U(64 - max(4, int(2 * len(keys)).bit_length()))
        size = 1 << (64 - int(self.shift))
        self.keys, self.values = np.full(size, -1, np.int64), np.zeros(size, np.int32)
        left = np.arange(len(keys))
        slot = self._slot(keys)
        while len(left):
            free = self.keys[slot] == -1
            self.keys[slot[free]] = keys[left[free]]
            won = self.keys[slot] == keys[left]
            self.values[slot[won]] = values[left[won]]
            left, slot = left[~won], (slot[~won] + 1) & (size - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(U) * U(BASE)) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers, and which keys are there."""
        slot = self._slot(keys)
        own = self.keys[slot]
        found = own == keys
        values = np.where(found, self.values[slot], np.int32(0))
        left = np.flatnonzero(~found & (own != -1))
        slot = slot[left]
        while len(left):
            slot = (slot + 1) & (len(self.keys) - 1)
            own = self.keys[slot]
            hit = own == keys[left]
            values[left[hit]] = self.values[slot[hit]]
            found[left[hit]] = True
            go = ~hit & (own != -1)
            left, slot = left[go], slot[go]
        return values, found


@dataclass
class Trie:
    """For each order: grams and counts; contexts with total, distinct symbols, and what those symbols count in the next shorter context."""

    keys: list[np.ndarray]
    counts: list[np.ndarray]
    contexts: list[np.ndarray]
    totals: list[np.ndarray]
    distinct: list[np.ndarray]
    shorter: list[np.ndarray]

    @classmethod
    def of(cls, by_order: list[tuple[np.ndarray, np.ndarray]]) -> Trie:
        made = cls([], [], [], [], [], [])
        for order, (keys, counts) in enumerate(by_order):
            contexts, at = np.unique(keys >> BITS, return_index=True)
            add = lambda x, at=at: np.add.reduceat(x, at) if len(at) else x[:0]
            below = np.zeros(len(keys), np.int64)
            if order:
                suffix = keys & ((1 << BITS * order) - 1)
                below = made.counts[order - 1][np.searchsorted(made.keys[order - 1], suffix)] if len(keys) else below
            made.keys.append(keys)
            made.counts.append(counts)
            made.contexts.append(contexts)
            made.totals.append(add(counts))
            made.distinct.append(add(np.ones(len(keys), np.int64)))
            made.shorter.append(add(below))
        return made

    def log10(self, packed: np.ndarray) -> np.ndarray:
        """log10 of each gram's last symbol's chance after the symbols before it."""
        out = np.zeros(len(packed))
        left = np.arange(len(packed))
        gone, mass = np.zeros(len(packed), np.int64), np.zeros(len(packed), np.int64)
        for order in range(len(self.keys) - 1, -1, -1):
            if not len(left) or not len(self.keys[order]):
                continue
            key = packed[left] & ((1 << BITS * (order + 1)) - 1)
            context, at = _find(self.contexts[order], key >> BITS)
            total = np.where(context, self.totals[order][at] - mass[left], 0)
            distinct = np.where(context, self.distinct[order][at] - gone[left], 0)
            known, k = _find(self.keys[order], key)
            whole = np.maximum(total + distinct, 1)
            chance = np.where(known, self.counts[order][k], np.where(distinct > 0, distinct, whole)) / whole
            out[left] += np.log10(chance)
            gone[left] = np.where(context, self.distinct[order][at], gone[left])
            mass[left] = np.where(context, self.shorter[order][at], mass[left])
            left = left[~known]
        out[left] -= np.log10(np.maximum(SYMBOLS - gone[left], 1))
        return out


def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(table, keys), max(len(table) - 1, 0))
    return table[at] == keys, at


COUNTS = "kind byte, key long, n long"


def corpus_counts(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """(kind, key, n): grams of the order (kind 0) and words (kind 1) of all texts. Each task adds up its own before they are dealt out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[list, list]] = [([], []), ([], [])]

        def flush(kind: int) -> Iterator[pa.RecordBatch]:
            keys, counts = summed(*held[kind])
            held[kind] = ([], [])
            for at in range(0, len(keys), 50000):
                k = keys[at : at + 50000]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), kind, np.int8)), pa.array(k), pa.array(counts[at : at + 50000])], names=["kind", "key", "n"])

        for batch in batches:
            for _, data, offsets in text_pieces(batch, limit=MODEL_PIECE):
                packed, _ = grams(data, offsets, order)
                own, _ = words(data, offsets)
                for kind, keys in ((0, packed), (1, own)):
                    k, n = np.unique(keys, return_counts=True)
                    if kind:
                        k, n = np.append(k, END_WORD), np.append(n, len(offsets) - 1)
                    held[kind][0].append(k)
                    held[kind][1].append(n)
                    if sum(map(len, held[kind][0])) > 1_000_000:
                        yield from flush(kind)
        for kind in (0, 1):
            if held[kind][0]:
                yield from flush(kind)

    return docs.select("text").mapInArrow(run, COUNTS).groupBy("kind", "key").agg(F.sum("n").alias("n"))


def least_count(counts: DataFrame, most: int) -> int:
    """The least n such that at most so many rows count n or more. Distinct counts are few: their number squared is at most twice the sum of all."""
    steps = counts.groupBy("n").agg(F.count("*").alias("rows"))
    upto = F.sum("rows").over(Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, 0))
    low, high = steps.select("n", upto.alias("upto")).agg(F.min(F.when(F.col("upto") <= most, F.col("n"))), F.max("n")).first()
    return low if low is not None else (high or 0) + 1


@dataclass
class Orders:
    """For each order, on the cluster: grams (key, n) and contexts (context, total, distinct, shorter), as in Trie; and chances (key, n, chance) of the longest grams."""

    grams: list[DataFrame]
    contexts: list[DataFrame]
    chances: DataFrame


def small(df: DataFrame, symbols: int) -> DataFrame:
    """df, to be broadcast where keys of so few symbols can only be few (two symbols: 66 000)."""
    return F.broadcast(df) if symbols <= 2 else df


def train(counts: DataFrame, order: int = ORDER) -> Orders:
    """All orders from all counted grams: shorter ones are summed from the next longer, contexts from their grams."""
    own = [counts.where("kind = 0").select("key", "n")]
    for o in range(order - 1, -1, -1):
        mask = (1 << BITS * (o + 1)) - 1
        own.insert(0, stored(own[0].groupBy(F.col("key").bitwiseAND(F.lit(mask)).alias("key")).agg(F.sum("n").alias("n")), "grams"))
    contexts = []
    for o, df in enumerate(own):
        df = df.withColumn("context", F.shiftright("key", BITS)).withColumn("below", F.lit(0).cast("bigint"))
        if o:
            shorter = own[o - 1].select(F.col("key").alias("suffix"), F.col("n").alias("m"))
            df = df.withColumn("suffix", F.col("key").bitwiseAND(F.lit((1 << BITS * o) - 1))).join(small(shorter, o), "suffix").withColumn("below", F.col("m"))
        contexts.append(stored(df.groupBy("context").agg(F.sum("n").alias("total"), F.count("*").alias("distinct"), F.sum("below").alias("shorter")), "contexts"))
    longest = own[order].withColumn("context", F.shiftright("key", BITS)).join(contexts[order], "context")
    return Orders(own, contexts, stored(longest.select("key", "n", F.log10(F.col("n") / (F.col("total") + F.col("distinct"))).alias("chance")), "chances"))


def unseen_chances(keys: DataFrame, model: Orders) -> DataFrame:
    """(key, chance) of grams (key) of the longest order that never trained: as Trie.log10, a join with each order's contexts and grams a step."""
    order = len(model.grams) - 1
    zero = F.lit(0).cast("bigint")
    df = keys.select("key", zero.alias("gone"), zero.alias("mass"), F.lit(0.0).alias("chance"), F.lit(False).alias("done"))
    for o in range(order, -1, -1):
        own = F.col("key").bitwiseAND(F.lit((1 << BITS * (o + 1)) - 1))
        df = df.withColumn("own", own).withColumn("context", F.shiftright("own", BITS)).join(small(model.contexts[o], o), "context", "left")
        if o < order:
            df = df.join(small(model.grams[o].withColumnRenamed("key", "own"), o + 1), "own", "left")
        else:
            df = df.withColumn("n", F.lit(None).cast("bigint"))
        context = F.col("total").isNotNull()
        total = F.when(context, F.col("total") - F.col("mass")).otherwise(0)
        distinct = F.when(context, F.col("distinct") - F.col("gone")).otherwise(0)
        whole = F.greatest(total + distinct, F.lit(1))
        part = F.when(F.col("n").isNotNull(), F.col("n")).when(distinct > 0, distinct).otherwise(whole)
        df = df.select(
            "key",
            F.when(context & ~F.col("done"), F.col("distinct")).otherwise(F.col("gone")).alias("gone"),
            F.when(context & ~F.col("done"), F.col("shorter")).otherwise(F.col("mass")).alias("mass"),
            F.when(F.col("done"), F.col("chance")).otherwise(F.col("chance") + F.log10(part / whole)).alias("chance"),
            (F.col("done") | F.col("n").isNotNull()).alias("done"),
        )
    rest = F.log10(F.greatest(F.lit(SYMBOLS) - F.col("gone"), F.lit(1)))
    return df.select("key", (F.col("chance") - F.when(F.col("done"), 0.0).otherwise(rest)).alias("chance"))


_models: dict[str, tuple] = {}


def _prepared(token: str, given: tuple) -> tuple:
    """The lookup tables of grams and words with their values, made once in a worker."""
    if token not in _models:
        _models.clear()
        gram_keys, chances, word_keys, word_counts = given
        _models[token] = (Table(gram_keys), chances, Table(word_keys), np.log10(word_counts + 0.5))
    return _models[token]


SCORED = "id {id}, held_out boolean, n_tokens long, head_known long, head_sum double, score double, tail array<long>, grams array<long>"


def lm_scores(docs: DataFrame, order: int = ORDER, nodes: int = NODES, head: int = HEAD, id_col: str = "doc_id", text_col: str = "text", fold: int = 1, folds: int = 5) -> DataFrame:
    """Per row: id, held_out, n_tokens, n_known, train_tokens, base_score and score; rows whose crc32(id) mod folds is not fold train."""
    spark = docs.sparkSession
    held = F.crc32(F.coalesce(F.col("id").cast("string"), F.lit("")).cast("binary")) % folds == fold
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).select("id", held.alias("held_out"), "text")
    counts = stored(corpus_counts(rows.where("NOT held_out"), order), "counts", partition_by="kind")
    model = train(counts, order)
    frequent = model.chances.where(F.col("n") >= least_count(model.chances, nodes)).select("key", "chance").toArrow()
    gram_keys, chances = (frequent.column(i).to_numpy() for i in range(2))
    vocabulary = counts.where("kind = 1").select("key", "n")
    total, distinct = (int(x or 0) for x in vocabulary.agg(F.sum("n"), F.count("*")).first())
    often = least_count(vocabulary, head)
    known = vocabulary.where(F.col("n") >= often).toArrow()
    word_keys, word_counts = known.column(0).to_numpy(), known.column(1).to_numpy()
    scale = float(np.log10(total + 0.5 * (distinct + 1)))
    end = vocabulary.where(F.col("key") == END_WORD).agg(F.sum("n")).first()[0] or 0
    shared = spark.sparkContext.broadcast((gram_keys, chances, word_keys, word_counts))
    token = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        direct, chances, slots, logs = _prepared(token, shared.value)
        for batch in batches:
            for part, data, offsets in text_pieces(batch, limit=MODEL_PIECE):
                packed, at = grams(data, offsets, order)
                slot, found = direct.get(packed)
                values = np.zeros(len(packed))
                values[found] = chances[slot[found]]
                score = np.add.reduceat(values, at[:-1])
                others = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(~found)])[at].astype(np.int32)), pa.array(packed[~found]))
                own, firsts = words(data, offsets)
                text = np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))
                slot, found = slots.get(own)
                texts = len(firsts) - 1
                head_sum = np.bincount(text[found], logs[slot[found]], texts).astype(np.float64)
                head_known = np.bincount(text[found], minlength=texts)
                rest = np.bincount(text[~found], minlength=texts)
                tail = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(rest)]).astype(np.int32)), pa.array(own[~found]))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(np.diff(firsts) + 1), pa.array(head_known), pa.array(head_sum), pa.array(score), tail, others], names=["id", "held_out", "n_tokens", "head_known", "head_sum", "score", "tail", "grams"])

    scored = rows.mapInArrow(run, SCORED.format(id=rows.schema["id"].dataType.simpleString()))
    scored = stored(scored.withColumn("row", F.monotonically_increasing_id()), "scored")
    tail = scored.select("row", F.explode("tail").alias("key")).groupBy("row", "key").agg(F.count("*").alias("times"))
    rare = vocabulary.where(F.col("n") < often)
    tail = tail.join(rare, "key").groupBy("row").agg(F.sum(F.col("times") * (F.log10(F.col("n") + 0.5) - F.log10(F.lit(0.5)))).alias("tail_sum"), F.sum("times").alias("tail_known"))
    others = stored(scored.select("row", F.explode("grams").alias("key")).groupBy("row", "key").agg(F.count("*").alias("times")), "others")
    trained = model.chances.select("key", "chance")
    unseen = others.select("key").distinct().join(trained, "key", "left_anti")
    others = others.join(trained.unionByName(unseen_chances(unseen, model)), "key").groupBy("row").agg(F.sum(F.col("times") * F.col("chance")).alias("others_sum"))
    out = scored.select("id", "held_out", "n_tokens", "head_known", "head_sum", "score", F.size("tail").alias("rest"), "row").join(tail, "row", "left").join(others, "row", "left")
    score = F.col("score") + F.coalesce("others_sum", F.lit(0.0))
    base = F.col("head_sum") + F.col("rest") * F.log10(F.lit(0.5)) + F.coalesce("tail_sum", F.lit(0.0)) + float(np.log10(end + 0.5)) - F.col("n_tokens") * scale
    n_known = F.col("head_known") + F.coalesce("tail_known", F.lit(0)) + (1 if end else 0)
    return out.select(F.col("id").alias(id_col), "held_out", "n_tokens", n_known.cast("long").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score"), score.alias("score"))
