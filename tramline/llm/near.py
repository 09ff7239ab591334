"""N-gram Jaccard join by chosen paths.

A text is the set of its five-word shingles. Equal sets are one node. Each node carries a MinHash signature; a run of the join starts from one
coordinate of it, and nodes that agree there share a bucket. A bucket over LIMIT is split again: coordinates drawn by the
bucket's own seed are the paths its nodes may follow, and each node goes on to the buckets of its values there. Small buckets are
compared by brute force. Runs repeat, each from another coordinate, until the target recall holds for the least similarity.

What the bounds leave over is not dropped: a bucket that is large after the last split, as one of many near copies is, is
compared whole, in pairs of blocks, one pair a task.

Defined results: a null text, and one without words, has no shingles, no links and a class of its own; a text of fewer words than five
has one shingle; rows alike share a node; the class of rows without any id is null; a very long text is one set, in memory some
hundred times its size while it is made; an empty table gives an empty result. Extra columns are not read.

Links are counted exactly, so that a group of near copies that are all different costs the square of its size in comparisons, and each
set goes to as many pairs of blocks as its bucket has blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import row_keys, stored
from .kernels import BASE, MIX, U, mix, shingle_sets, text_pieces

#: Coordinates of a signature beyond those that runs start from.
SPARE = 40
#: Paths that go on from a bucket.
BRANCHES = 2
#: Rows of a bucket that are compared at once, splits of a bucket, and rows of a block of what stays large.
LIMIT, DEPTH, BLOCK = 256, 3, 512
#: A bucket is not split where this part of it, or more, would go on together.
TOGETHER = 0.5
#: Chance that a pair of the least similarity is missed by all runs.
MISS = 1e-4


def runs_for(similarity: float, miss: float = MISS, depth: int = DEPTH) -> int:
    """Runs until a pair of the given similarity, split at every level, is missed with at most the chance given."""
    survives = similarity * (1 - (1 - similarity) ** BRANCHES) ** depth
    return math.ceil(math.log(miss) / math.log(1 - survives))


def _salts(n: int) -> tuple[np.ndarray, np.ndarray]:
    x = mix(np.arange(1, 2 * n + 1, dtype=U) * U(BASE))
    return x[:n], x[n:] | U(1)


def set_rows(hashes: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each set that is not empty: 128 bits that name it, and its signature of 32-bit minima in width coordinates."""
    n = np.diff(offsets)
    at = offsets[:-1][n > 0]
    if not len(at):
        return np.zeros(0, U), np.zeros(0, U), np.zeros((0, width), np.uint32)
    size = n[n > 0].astype(U)
    names = [mix(np.add.reduceat(mix(hashes ^ U(c)), at) ^ size) for c in MIX]
    a, b = _salts(width)
    signature = np.empty((len(at), width), np.uint32)
    for i in range(width):
        signature[:, i] = np.minimum.reduceat((hashes ^ a[i]) * b[i], at) >> U(32)
    return names[0], names[1], signature


SET_SCHEMA = "id {id}, k1 long, k2 long, n long, s1 long, s2 long, signature binary"


def signatures(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """Per row: id, row keys, size of its set (n), name of its set (s1, s2) and signature; null where the set is empty."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).select("id", "text", *row_keys("id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in text_pieces(batch):
                hashes, at = shingle_sets(data, offsets)
                n = np.diff(at)
                s1, s2, signature = set_rows(hashes, at, width)
                raw = iter([own.tobytes() for own in signature])
                full = n > 0
                names = [np.zeros(len(n), np.int64) for _ in range(2)]
                for own, s in zip(names, (s1, s2)):
                    own[full] = s.view(np.int64)
                columns = [part.column(0), part.column(2), part.column(3), pa.array(n), pa.array(names[0], mask=~full), pa.array(names[1], mask=~full), pa.array([next(raw) if f else None for f in full.tolist()], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "k1", "k2", "n", "s1", "s2", "signature"])

    return rows.mapInArrow(run, SET_SCHEMA.format(id=rows.schema["id"].dataType.simpleString()))


def value_at(coordinate: Column) -> Column:
    return F.substring(F.col("signature"), coordinate * 4 + 1, F.lit(4))


def leaves(nodes: DataFrame, runs: int) -> DataFrame:
    """(leaf, node, size): the buckets of two nodes or more that no split is left for, or that are small."""
    spare = SPARE
    rows = nodes.select("node", "signature", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))).alias("run"))
    rows = rows.select("node", "signature", F.xxhash64(F.col("run"), value_at(F.col("run"))).alias("path"))
    found = None
    for level in range(DEPTH + 1):
        sizes = rows.groupBy("path").agg(F.count("*").alias("size")).where("size > 1")
        rows = stored(rows.join(sizes, "path"), "paths")
        closed = rows if level == DEPTH else rows.where(F.col("size") <= LIMIT)
        rows = rows.where(F.col("size") > LIMIT)
        more = level < DEPTH and not rows.isEmpty()
        if more:
            first = F.pmod(F.xxhash64("path", F.lit(level)), F.lit(spare))
            second = F.pmod(first + 1 + F.pmod(F.xxhash64("path", F.lit(-1 - level)), F.lit(spare - 1)), F.lit(spare))
            children = rows.withColumn("c", F.explode(F.array(first, second))).withColumn("c", (F.col("c") + runs).cast("int"))
            children = stored(children.select("node", "signature", F.col("path").alias("parent"), "size", F.xxhash64("path", "c", value_at(F.col("c"))).alias("path")), "paths")
            # A bucket of near copies goes on together whichever coordinate is drawn: it is compared whole instead.
            largest = children.groupBy("parent", "size", "path").agg(F.count("*").alias("part")).groupBy("parent", "size").agg(F.max("part").alias("part"))
            whole = largest.where(F.col("part") > F.col("size") * TOGETHER).select(F.col("parent").alias("path"))
            closed = closed.unionByName(rows.join(whole, "path", "left_semi").select(*closed.columns))
            rows = children.join(whole.withColumnRenamed("path", "parent"), "parent", "left_anti").select("node", "signature", "path")
        closed = closed.select(F.col("path").alias("leaf"), "node", "size")
        found = closed if found is None else found.unionByName(closed)
        if not more:
            break
    return found


def in_blocks(rows: DataFrame) -> DataFrame:
    """Adds the pair of blocks (bi, bj) that a row is compared in, and its own block b. A leaf that is not large is one block."""
    count = F.when(F.col("size") > 2 * LIMIT, F.ceil(F.col("size") / BLOCK)).otherwise(1).cast("int")
    rows = rows.withColumn("b", F.pmod(F.xxhash64("node", "leaf"), count).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), count - 1)))
    return rows.select("leaf", F.least("b", "other").alias("bi"), F.greatest("b", "other").alias("bj"), "b", "node")


def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of rows alike in leaf, bi and bj from batches sorted by them."""
    left = None
    for batch in batches:
        if left is not None:
            batch = pa.Table.from_batches([left, batch]).combine_chunks().to_batches()
            batch = batch[0] if batch else left
        if not batch.num_rows:
            continue
        keys = [np.asarray(batch.column(i)) for i in range(3)]
        new = np.zeros(batch.num_rows, bool)
        new[0] = True
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
        at = np.flatnonzero(new)
        for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
            yield batch.slice(a, b - a)
        left = batch.slice(int(at[-1]))
    if left is not None and left.num_rows:
        yield left


def shared_counts(lists: list[np.ndarray], most: int = 1 << 24) -> np.ndarray:
    """How many values each pair of lists shares: products of slices of the table of lists by values, of at most so many cells."""
    if len(lists) == 2:
        n = len(np.intersect1d(lists[0], lists[1], assume_unique=True))
        return np.array([[0, n], [n, 0]])
    where = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    values = np.concatenate(lists)
    order = np.argsort(values, kind="stable")
    values, where = values[order], where[order]
    new = np.concatenate([[True], values[1:] != values[:-1]]) if len(values) else np.zeros(0, bool)
    column = np.cumsum(new) - 1
    # Values of one list are shared by none.
    shared = np.bincount(column) > 1 if len(values) else np.zeros(0, bool)
    keep = shared[column]
    where, column = where[keep], (np.cumsum(shared) - 1)[column[keep]]
    out = np.zeros((len(lists), len(lists)))
    width = max(1, min(most // max(1, len(lists)), int(shared.sum())))
    for at in range(0, int(shared.sum()), width):
        a, b = np.searchsorted(column, [at, at + width])
        part = np.zeros((len(lists), width), np.float32)
        part[where[a:b], column[a:b] - at] = 1
        out += part @ part.T
    return out


def open_pairs(group: pa.RecordBatch, similarity: float) -> np.ndarray | None:
    """Which pairs of a group's rows are to be verified here: alike enough by size and signature, and not met in a lower leaf."""
    leaf, bi, bj = (group.column(i)[0].as_py() for i in range(3))
    b, n = np.asarray(group.column(3)), np.asarray(group.column(5)).astype(np.float64)
    signature = np.frombuffer(b"".join(group.column(6).to_pylist()), np.uint32).reshape(len(n), -1)
    width = signature.shape[1]
    pairs = np.triu(np.ones((len(n), len(n)), bool), 1)
    if bi != bj:
        pairs &= b[:, None] != b[None, :]
    pairs &= np.minimum(n[:, None], n[None, :]) >= similarity * np.maximum(n[:, None], n[None, :])
    if not pairs.any():
        return None
    alike = np.zeros(pairs.shape, np.int16)
    for c in range(width):
        alike += signature[:, c, None] == signature[None, :, c]
    # Six deviations under what the least similarity gives.
    pairs &= alike >= width * similarity - 6 * math.sqrt(width * similarity * (1 - similarity))
    if not pairs.any():
        return None
    column = group.column(4 + 3)
    lower = [own[own < leaf] for own in (np.asarray(x.values) for x in column)]
    met = shared_counts(lower) if len(lower) > 2 else np.full(pairs.shape, len(np.intersect1d(lower[0], lower[1])))
    pairs &= met == 0
    return pairs if pairs.any() else None


def mark(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    out: list[pa.RecordBatch] = []
    for group in groups(batches):
        pairs = open_pairs(group, similarity) if group.num_rows > 1 else None
        if pairs is not None:
            out.append(group.filter(pa.array(pairs.any(0) | pairs.any(1))).select([0, 1, 2, 3, 4]))
        if len(out) >= 2000:
            yield from pa.Table.from_batches(out).combine_chunks().to_batches()
            out = []
    if out:
        yield from pa.Table.from_batches(out).combine_chunks().to_batches()


def verify(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    out: list[tuple[int, int, int]] = []
    for group in groups(batches):
        pairs = open_pairs(group, similarity) if group.num_rows > 1 else None
        if pairs is None:
            continue
        sets = [np.frombuffer(x, U) for x in group.column(8).to_pylist()]
        n = np.array([len(x) for x in sets], np.float64)
        common = shared_counts(sets)
        pairs &= common >= similarity * (n[:, None] + n[None, :] - common) - 1e-9
        links = pairs | pairs.T
        degree = links.sum(0)
        node = np.asarray(group.column(4))
        root = np.arange(len(node))
        for i in np.flatnonzero(degree).tolist():
            near = np.flatnonzero(links[i])
            known = np.unique(root[np.append(near, i)])
            root[np.isin(root, known)] = known[0]
        for i in np.flatnonzero(degree).tolist():
            out.append((int(node[i]), int(degree[i]), int(node[root[i]])))
        if len(out) >= 10000:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], names=["node", "links", "root"])
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], names=["node", "links", "root"])


#: Salts by which the edges of a node meet what is known of it: the centre of a large class is one key of many rows.
SALTS = 8


def with_least(edges: DataFrame, least: DataFrame) -> DataFrame:
    """edges (u, v) with the columns of least, a row a node u, joined by u and a salt of v."""
    salted = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return edges.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")).join(salted, ["u", "salt"]).drop("salt")


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of the nodes of edges (u, v): the least node of each connected component, by alternating stars.

    Every round is a join and an aggregation; its edges are written to the shared folder, and rounds end when a round changes none.
    """
    edges = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = with_least(both.where("v > u"), least).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = with_least(down, low).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        edges = stored(small.where("u <> v").distinct(), "edges")
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
        seen = now


def near_duplicates(docs: DataFrame, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text", keys: bool = False) -> DataFrame:
    """Per row: id, class_id (the least id of its class), n_links (distinct other sets at the similarity or more) and n_same (rows with its set).

    Only signatures travel to find candidates. Texts move once, to those rows that stand for a node with a candidate, and sets only
    to the buckets in which a pair of theirs is verified. With keys, the row keys k1 and k2 come along, and first: whether
    the row is the first of its class by id and key.
    """
    runs = runs_for(similarity)
    rows = stored(signatures(docs, id_col, text_col, runs + SPARE), "signatures")
    nodes = rows.where("n > 0").dropDuplicates(["s1", "s2"]).withColumn("node", F.monotonically_increasing_id())
    nodes = stored(nodes.select("node", "s1", "s2", "k1", "k2", "n", "signature"), "nodes")
    found = stored(leaves(nodes, runs), "leaves")
    about = nodes.select("node", "n", "signature").join(found.groupBy("node").agg(F.collect_list("leaf").alias("leaves")), "node")
    order = ["leaf", "bi", "bj"]
    ready = in_blocks(found).join(about, "node").select(*order, "b", "node", "n", "signature", "leaves")
    marked = ready.repartition(*order).sortWithinPartitions(*order).mapInArrow(lambda x: mark(x, similarity), "leaf long, bi int, bj int, b int, node long")
    marked = stored(marked, "marked")

    wanted = nodes.join(marked.select("node").distinct(), "node", "left_semi").select("k1", "k2", "node")
    texts = docs.select(*row_keys(id_col, text_col), F.col(text_col).alias("text")).join(wanted.hint("shuffle_hash"), ["k1", "k2"]).select("node", "text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in text_pieces(batch):
                hashes, at = shingle_sets(data, offsets)
                own = [hashes[a:b].tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(own, pa.binary())], names=["node", "shingles"])

    own_sets = texts.mapInArrow(sets, "node long, shingles binary").dropDuplicates(["node"])
    ready = marked.join(about, "node").join(own_sets, "node").select(*order, "b", "node", "n", "signature", "leaves", "shingles")
    links = ready.repartition(*order).sortWithinPartitions(*order).mapInArrow(lambda x: verify(x, similarity), "node long, links long, root long")
    links = stored(links, "links")
    labels = components(links.select(F.col("node").alias("u"), F.col("root").alias("v")))
    degree = links.groupBy("node").agg(F.sum("links").alias("n_links"))

    named = nodes.select("node", "s1", "s2").join(degree, "node", "left").join(labels, "node", "left")
    named = named.select("s1", "s2", F.coalesce("label", "node").alias("label"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    copies = rows.where("n > 0").groupBy("s1", "s2").agg(F.count("*").alias("n_same"), F.min("id").alias("least"))
    named = named.join(copies, ["s1", "s2"])
    classes = named.groupBy("label").agg(F.min("least").alias("class_id"))
    named = named.join(classes, "label").drop("least")
    out = rows.select("id", "k1", "k2", "s1", "s2").join(named, ["s1", "s2"], "left")
    columns = [F.col("id").alias(id_col), F.when(F.col("label").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("n_same", F.lit(1)).alias("n_same")]
    return out.select(*columns, *(["k1", "k2", "label"] if keys else []))
