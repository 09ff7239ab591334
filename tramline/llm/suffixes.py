"""Exact substring dedup by suffix arrays: every byte covered by a string of LENGTH bytes that also starts elsewhere goes.

Repeats of PASSAGE bytes or more are reported too, and stay: the same suffix arrays give both.

1. Windows of PASSAGE bytes are dealt out by content: a window's anchor is the 32-byte gram of least hash in it, so equal windows have
   equal anchors wherever they stand. The windows in a row that share an anchor are one context: the bytes from its first window's
   start up to LENGTH bytes past its last one's, or to the text's end. An anchor that stands once has no repeats.
2. Of the others, contexts alike are counted; those that stand twice are repeats whole. One row of each context of an anchor with others goes on.
3. Anchors are dealt to shards of some megabytes. In each, a suffix array of the contexts is built by Larsson-Sadakane refinement, and
   Kasai's pass gives common prefixes with the window before in its order: LENGTH or more (PASSAGE or more) marks both windows.
4. An anchor with more contexts than a shard holds is spread over several. Each sends the sorted digests of its windows, cut in
   ranges, and ranges are merged by binary search.
5. The spans of each text are united; those of LENGTH are cut out.

Defined results: a null or empty text, and one shorter than PASSAGE, loses and repeats nothing; rows alike are occurrences of their own
and are answered alike; a very long text is read in overlapping pieces; an empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, row_keys, stored
from .kernels import INVERSE, PIECE, U, merged_runs, mix, powers, prefix_sums, span_hashes, text_pieces

LENGTH, GRAM = 400, 32
#: Bytes from which a repeat is reported, though it may be too short to be removed: fifty words of five letters and a space.
PASSAGE = 300
#: Bytes of contexts in a shard.
SHARD = 1 << 20
#: Low bits that hold a gram's place while the least hash is sought; equal hashes yield the first.
PLACE = 31


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each width values in a row: blocks' running minima from both sides meet in every window."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, U)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def contexts(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, passage: int = PASSAGE, most: int | None = None) -> tuple[np.ndarray, ...]:
    """Runs of windows that share an anchor: (text, first window's start in the text, windows, bytes, anchor's hash, context's hash).

    most: windows of a text that are taken, where the rest are another piece's.
    """
    width = passage - GRAM + 1
    n = len(data) - passage + 1
    valid = np.ones(max(n, 0), bool)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        valid[max(a, b - passage + 1) : b] = False
    if most is not None:
        valid[most:] = False
    if not valid.any():
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, empty, empty.view(U), empty.view(U)
    sums, back = prefix_sums(data), powers(INVERSE, len(data) + 1)
    hashes = mix((sums[GRAM:] - sums[:-GRAM]) * back[: len(data) - GRAM + 1])
    places = np.arange(len(hashes), dtype=U)
    anchor = sliding_least((hashes >> U(PLACE) << U(PLACE)) | places, width) & U((1 << PLACE) - 1)
    other = anchor[1:] != anchor[:-1]
    # Between the windows of two texts there are some that belong to none.
    new, last = valid.copy(), valid.copy()
    new[1:] &= other | ~valid[:-1]
    last[:-1] &= other | ~valid[1:]
    begin = np.flatnonzero(new)
    count = np.flatnonzero(last) - begin + 1
    text = np.searchsorted(offsets, begin, "right") - 1
    end = np.minimum(begin + count - 1 + length, offsets[text + 1])
    # Contexts alike in bytes but not in windows, as at the end of a text, are told apart.
    names = mix(mix((sums[end] - sums[begin]) * back[begin]) + count.astype(U) + ((end - begin).astype(U) << U(32)))
    return text, begin - offsets[text], count, end - begin, hashes[anchor[begin].astype(np.int64)], names


def suffix_array(data: np.ndarray, ends: np.ndarray, least: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Positions sorted by the bytes from there to the end of their part, the eight bytes from each position packed, what is left of its part, and which positions may share least bytes with another.

    ends are where the parts end. A part's end sorts before all bytes and differs from any other, so no match runs past it.
    """
    n = len(data)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    packed = np.zeros(n, U)
    for k in range(8):
        packed = (packed << U(8)) | padded[k : n + k]
    sizes = np.diff(np.concatenate([[0], ends]))
    left = np.repeat(ends, sizes) - np.arange(n)
    full, short = np.flatnonzero(left >= 8), np.flatnonzero(left < 8)
    cut = packed[short] >> ((8 - left[short]) * 8).astype(U) << ((8 - left[short]) * 8).astype(U)
    order = np.lexsort((short, left[short], cut))
    short, cut = short[order], cut[order]
    full = full[np.argsort(packed[full])]
    keys = packed[full]
    sa = np.insert(full, np.searchsorted(keys, cut, "left"), short)
    rank_key = packed[sa]
    alone = left[sa] < 8
    new = np.ones(n, bool)
    new[1:] = (rank_key[1:] != rank_key[:-1]) | alone[1:] | alone[:-1]
    # A group's rank is the place of its last member.
    rank = np.empty(n, np.int32)
    short_left = left.astype(np.int32)

    def last_of(new: np.ndarray, base: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(new)
        sizes = np.diff(np.concatenate([at, [len(new)]]))
        return np.repeat(base[at + sizes - 1], sizes)

    rank[sa] = last_of(new, np.arange(n))
    tied = ~new
    tied[:-1] |= ~new[1:]
    member = np.flatnonzero(tied)
    group = np.cumsum(new)[member]
    bits = n.bit_length() + 1
    h = 8
    deep = np.ones(n, bool)
    while len(member):
        at = sa[member]
        if h <= least:
            # Positions that the first h bytes tell from all others share less.
            deep[:] = False
            deep[at] = True
        # Members lie in order of their groups: numbered anew, these leave room for two steps' ranks in 64 bits.
        group = np.cumsum(np.concatenate([[False], group[1:] != group[:-1]])).astype(U)
        room = 64 - max(1, int(group[-1]).bit_length())
        key, steps = group, 0
        while steps < 2 and room >= bits:
            steps, room = steps + 1, room - bits
            # Where the part ends before, its end comes next: before all ranks, by part. What follows an end decides nothing.
            far = at + steps * h
            beyond = np.where(short_left[at] > steps * h, rank[np.minimum(far, n - 1)] + n, at)
            key = (key << U(bits)) | beyond.astype(U)
        order = np.argsort(key)
        key, at = key[order], at[order]
        sa[member] = at
        new = np.ones(len(member), bool)
        new[1:] = key[1:] != key[:-1]
        rank[at] = last_of(new, member)
        tied = ~new
        tied[:-1] |= ~new[1:]
        group = np.cumsum(new)[tied]
        member = member[tied]
        h *= steps + 1
    if h <= least:
        deep[:] = False
    return sa, packed, left, deep


def leading_zero_bytes(x: np.ndarray) -> np.ndarray:
    """Of numbers other than 0."""
    out = np.zeros(len(x), np.int64)
    for bits in (32, 16, 8):
        zero = x >> U(64 - bits) == 0
        out += np.where(zero, bits // 8, 0)
        x = np.where(zero, x << U(bits), x)
    return out


def common_prefixes(sa: np.ndarray, packed: np.ndarray, left: np.ndarray, chosen: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The chosen positions in the order of the suffix array, and the length each shares with the one before, up to most.

    Kasai's pass: along a run of chosen positions the length falls by one at most, as long as the position before moves along with
    it. All runs take their steps together, and compare eight bytes at a time.
    """
    n = len(sa)
    ranked = sa[chosen[sa]]
    before = np.full(n, -1, np.int64)
    before[ranked[1:]] = ranked[:-1]
    edge = np.flatnonzero(np.diff(np.concatenate([[0], chosen.view(np.int8), [0]])))
    starts, sizes = edge[::2], edge[1::2] - edge[::2]
    window = np.append(chosen, False)
    out = np.zeros(n, np.int64)
    length = np.zeros(len(starts), np.int64)
    met = np.zeros(len(starts), bool)
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = starts[order], sizes[order]
    live = len(starts)
    for step in range(int(sizes[0]) if len(sizes) else 0):
        while live and sizes[live - 1] <= step:
            live -= 1
        i = starts[:live] + step
        j = before[i]
        own = np.where(met[:live] & (j >= 0), np.maximum(length[:live] - 1, 0), 0)
        top = np.where(j >= 0, np.minimum(np.minimum(left[i], left[j]), most), 0)
        own = np.minimum(own, top)
        go = np.flatnonzero(own < top)
        while len(go):
            x = packed[i[go] + own[go]] ^ packed[j[go] + own[go]]
            differ = x != 0
            ends = go[differ]
            own[ends] = np.minimum(own[ends] + leading_zero_bytes(x[differ]), top[ends])
            go = go[~differ]
            own[go] = np.minimum(own[go] + 8, top[go])
            go = go[own[go] < top[go]]
        out[i] = own
        length[:live] = own
        # The next suffix of the window before is a window too, and so stands before the next one here.
        met[:live] = window[j + 1] & (j >= 0)
    return ranked, out[ranked]


def repeated_windows(parts: list[bytes], windows: np.ndarray, lengths: tuple[int, ...] = (PASSAGE, LENGTH)) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Which windows of the parts (the first so many positions of each) share each of the lengths with another: (repeated by position, a list), starts of parts, bytes."""
    data = np.frombuffer(b"".join(parts), np.uint8)
    sizes = np.array([len(p) for p in parts], np.int64)
    ends = np.cumsum(sizes)
    sa, packed, left, deep = suffix_array(data, ends, min(lengths))
    windows = np.asarray(windows, np.int64)
    chosen = np.zeros(len(data), bool)
    chosen[np.repeat(ends - sizes, windows) + np.arange(int(windows.sum())) - np.repeat(np.cumsum(windows) - windows, windows)] = True
    ranked, shared = common_prefixes(sa, packed, left, chosen & deep, max(lengths))
    found = []
    for length in lengths:
        repeated = np.zeros(len(data), bool)
        hit = np.flatnonzero(shared[1:] >= length) + 1
        repeated[ranked[hit]] = True
        repeated[ranked[hit - 1]] = True
        found.append(repeated)
    return found, ends - sizes, data


#: kind 0 is a repeat of PASSAGE bytes, kind 1 one of LENGTH.
CONTEXTS = "k1 long, k2 long, key long, c1 long, start long, windows int, bytes int"
FOUND = "k1 long, k2 long, kind byte, s long, e long, key long, part int, sub int, digests binary, checks binary, places binary"
SPANS = "k1 long, k2 long, kind byte, s long, e long"


def context_rows(rows: DataFrame, length: int, passage: int, piece: int = PIECE) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(part: pa.RecordBatch, at: int, text: np.ndarray, start: np.ndarray, *rest: np.ndarray) -> pa.RecordBatch:
            count, size, key, c1 = rest
            k1, k2 = (np.asarray(part.column(i))[text] for i in range(2))
            columns = (k1, k2, key.view(np.int64), c1.view(np.int64), start + at, count.astype(np.int32), size.astype(np.int32))
            return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["k1", "k2", "key", "c1", "start", "windows", "bytes"])

        for batch in batches:
            for part, data, offsets in text_pieces(batch, limit=piece):
                if len(data) <= 2 * piece or part.num_rows > 1:
                    yield made(part, 0, *contexts(data, offsets, length, passage))
                    continue
                for at in range(0, len(data), piece):
                    own = data[at : at + piece + length]
                    yield made(part, at, *contexts(own, np.array([0, len(own)]), length, passage, piece))

    return rows.select("k1", "k2", "text").mapInArrow(run, CONTEXTS)


def spans_of_windows(owner: np.ndarray, places: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What windows of the length cover, from their places in order within each owner: (first window's index, starts, ends)."""
    new = np.ones(len(places), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (places[1:] > places[:-1] + length)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(places))[: len(first)] - 1
    return first, places[first], places[last] + length


def shard_repeats(table: pa.Table, length: int, passage: int) -> pa.Table:
    """The spans that a shard finds for contexts standing once; for a spread anchor also its windows' digests, sorted and cut in ranges."""
    parts = table.column("bytes").to_pylist()
    windows, n, start, k1, k2 = (table.column(c).to_numpy() for c in ("windows", "n", "start", "k1", "k2"))
    lengths = (passage, length)
    found, at, data = repeated_windows(parts, windows, lengths)
    ranges = int(table.column("parts")[0].as_py())
    out: dict[str, list] = {c.split()[0]: [] for c in FOUND.split(", ")}
    spans = []

    def add(**row: object) -> None:
        for c, own in out.items():
            own.append(row.get(c))

    for kind, (size, repeated) in enumerate(zip(lengths, found)):
        hit = np.flatnonzero(repeated)
        own = np.searchsorted(at, hit, "right") - 1
        hit, own = hit[n[own] == 1], own[n[own] == 1]
        first, s, e = spans_of_windows(own, hit - at[own] + start[own], size)
        spans.append(pa.table({"k1": k1[own[first]], "k2": k2[own[first]], "kind": np.full(len(s), kind, np.int8), "s": s, "e": e}))
    if ranges > 1:
        part = np.repeat(np.arange(len(parts)), windows)
        offset = np.arange(len(part)) - np.repeat(np.cumsum(windows) - windows, windows)
        ends = np.append(at[1:], len(data))[part]
        for kind, (size, repeated) in enumerate(zip(lengths, found)):
            fits = at[part] + offset + size <= ends
            own_part, own_offset = part[fits], offset[fits]
            place = at[own_part] + own_offset
            first, second = (span_hashes(data, place, place + size, salt) for salt in (2, 3))
            open_ = (n[own_part] == 1) & ~repeated[place]
            # Of windows alike in this shard one is enough.
            order = np.lexsort((~open_, first))
            if not len(order):
                continue
            order = order[np.concatenate([[True], first[order][1:] != first[order][:-1]])]
            record = np.zeros(len(order), [("k1", np.int64), ("k2", np.int64), ("at", np.int64)])
            own = own_part[order]
            record["k1"], record["k2"] = k1[own], k2[own]
            record["at"] = np.where(open_[order], start[own] + own_offset[order], -1)
            cut = np.searchsorted(first[order], (np.arange(1, ranges, dtype=np.float64) * (2.0**64 / ranges)).astype(U))
            key, sub = int(table.column("key")[0].as_py()), int(table.column("sub")[0].as_py())
            for r, (a, b) in enumerate(zip([0, *cut.tolist()], [*cut.tolist(), len(order)])):
                if b > a:
                    add(kind=kind, key=key, part=r, sub=sub, digests=first[order][a:b].tobytes(), checks=second[order][a:b].tobytes(), places=record[a:b].tobytes())
    kinds = {"long": pa.int64(), "byte": pa.int8(), "int": pa.int32(), "binary": pa.binary()}
    schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in FOUND.split(", ")])
    return pa.concat_tables([pa.table([pa.array(out[f.name], f.type) for f in schema], schema), *spans], promote_options="default").cast(schema)


def merge_ranges(table: pa.Table, length: int, passage: int) -> pa.Table:
    """Open windows of any shard whose digest another shard of the anchor holds too: binary search of each sorted run in their merger."""
    kind = int(table.column("kind")[0].as_py())
    runs = [tuple(np.frombuffer(row[c], of) for c, of in (("digests", U), ("checks", U), ("places", [("k1", np.int64), ("k2", np.int64), ("at", np.int64)]))) for row in table.select(["digests", "checks", "places"]).to_pylist()]
    every = np.concatenate([d for d, _, _ in runs])
    order = np.argsort(every, kind="stable")
    every, checks = every[order], np.concatenate([c for _, c, _ in runs])[order]
    found = []
    for digests, own, places in runs:
        low, high = np.searchsorted(every, digests, "left"), np.searchsorted(every, digests, "right")
        twice = (high - low > 1) & (places["at"] >= 0)
        twice[twice] = (checks[low[twice]] == own[twice]) & (checks[low[twice] + 1] == own[twice])
        found.append(places[twice])
    hits = np.concatenate(found)
    hits = hits[np.lexsort((hits["at"], hits["k2"], hits["k1"]))]
    other = np.ones(len(hits), bool)
    other[1:] = (hits["k1"][1:] != hits["k1"][:-1]) | (hits["k2"][1:] != hits["k2"][:-1])
    first, s, e = spans_of_windows(np.cumsum(other), hits["at"], (passage, length)[kind])
    return pa.table({"k1": hits["k1"][first], "k2": hits["k2"][first], "kind": np.full(len(s), kind, np.int8), "s": s, "e": e})


def listed(column: pa.ListArray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """The structs of a column of lists: the row each is of, and their fields."""
    sizes = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(column), 0))
    values = pa.compute.list_flatten(column)
    return np.repeat(np.arange(len(sizes)), sizes), {f.name: np.asarray(values.field(i)) for i, f in enumerate(values.type)}


def suffix_dedup(docs: DataFrame, length: int = LENGTH, passage: int = PASSAGE, shard: int = SHARD, piece: int = PIECE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_bytes, n_removed, n_spans (maximal runs removed), kept_sha256, and n_repeated: bytes in strings of passage bytes that also start elsewhere.

    Texts move twice, dealt by id and text: to cut the contexts that shards need, and to cut out what repeats. passage is at most length.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).select("id", "text", *row_keys("id"))
    every = stored(context_rows(rows, length, passage, piece), "contexts")
    # Most anchors stand once: their contexts go no further.
    several = stored(every.groupBy("key").agg(F.count("*").alias("rows")).where("rows > 1").select("key"), "anchors-with-others")
    runs = stored(every.join(several, "key", "left_semi"), "shared-contexts")
    discard(every)
    seen = runs.groupBy("key", "c1").agg(F.count("*").alias("n"), F.min_by(F.struct("k2", "start", "windows", "bytes"), "k1").alias("at"), F.min("k1").alias("k1"))
    seen = stored(seen.select("key", "c1", "n", "k1", "at.*"), "distinct-contexts")
    keys = seen.groupBy("key").agg(F.count("*").alias("m"), F.sum(F.when(F.col("n") == 1, 1).otherwise(0)).alias("once"), F.sum(F.col("bytes").cast("long")).alias("size")).where("m > 1 AND once > 0").select("key", "size")
    keys = stored(keys, "anchors")
    shards = max(1, -(-int(keys.where(F.col("size") <= shard).agg(F.sum("size")).first()[0] or 0) // shard))
    wanted = seen.join(keys, "key").groupBy("k1", "k2").agg(F.collect_list(F.struct("key", "c1", "n", "start", "windows", "bytes", "size")).alias("cut"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in text_pieces(batch):
                raw = data.tobytes()
                of, own = listed(part.column(3))
                begin = offsets[of] + own["start"]
                pieces = [raw[a:b] for a, b in zip(begin.tolist(), (begin + own["bytes"]).tolist())]
                columns = {"k1": np.asarray(part.column(0))[of], "k2": np.asarray(part.column(1))[of], **{c: own[c] for c in ("key", "c1", "n", "start", "windows", "size")}}
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns.values()), pa.array(pieces, pa.binary())], names=[*columns, "bytes"])

    texts = rows.select("k1", "k2", "text").join(wanted.hint("shuffle_hash"), ["k1", "k2"])
    parts = texts.mapInArrow(cut, "k1 long, k2 long, key long, c1 long, n long, start long, windows int, size long, bytes binary").dropDuplicates(["k1", "k2", "start"])
    spread = F.col("size") > shard
    count = F.when(spread, F.ceil(F.col("size") / shard)).otherwise(1).cast("int")
    parts = parts.withColumn("parts", count).withColumn("sub", F.when(spread, F.pmod(F.xxhash64("c1"), count)).otherwise(-1).cast("int"))
    parts = parts.withColumn("shard", F.when(spread, F.col("key")).otherwise(F.pmod(F.xxhash64("key"), F.lit(shards))))
    found = stored(parts.groupBy("shard", "sub").applyInArrow(lambda table: shard_repeats(table, length, passage), FOUND), "repeats")
    merged = found.where("key IS NOT NULL").select("key", "kind", "part", "sub", "digests", "checks", "places").groupBy("key", "kind", "part").applyInArrow(lambda table: merge_ranges(table, length, passage), SPANS)
    # Contexts that stand twice repeat whole: all windows of passage bytes, and of length bytes those that do not reach past the text.
    twice = runs.join(seen.where("n > 1").select("key", "c1"), ["key", "c1"], "left_semi")
    last = F.col("start") + F.col("windows") - 1 + passage
    both = [F.struct(F.lit(0).cast("byte").alias("kind"), F.col("start").alias("s"), last.alias("e")), F.struct(F.lit(1).cast("byte").alias("kind"), F.col("start").alias("s"), (F.col("start") + F.col("bytes")).alias("e"))]
    whole = twice.select("k1", "k2", F.explode(F.array(*both)).alias("x")).select("k1", "k2", "x.*").where((F.col("kind") == 0) | (F.col("e") - F.col("s") >= length))
    spans = found.where("key IS NULL").select("k1", "k2", "kind", "s", "e").unionByName(merged).unionByName(whole)
    spans = spans.groupBy("k1", "k2").agg(F.collect_set(F.struct("kind", "s", "e")).alias("spans"))
    held = rows.join(spans.hint("shuffle_hash"), ["k1", "k2"], "left").select("id", "text", "spans")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in text_pieces(batch):
                raw = data.tobytes()
                out: list[list] = [[], [], [], []]
                of, own = listed(part.column(2))
                first = np.searchsorted(of, np.arange(part.num_rows + 1))
                for k in range(part.num_rows):
                    text = raw[offsets[k] : offsets[k + 1]]
                    at = slice(first[k], first[k + 1])
                    kinds, begin, end = own["kind"][at], own["s"][at], own["e"][at]
                    (a, b), (s, e) = (merged_runs(begin[kinds == kind], end[kinds == kind]) for kind in (0, 1))
                    kept = b"".join(text[i:j] for i, j in zip([0, *e.tolist()], [*s.tolist(), len(text)])) if len(s) else text
                    for x, v in zip(out, (len(text) - len(kept), len(s), hashlib.sha256(kept).hexdigest(), int((b - a).sum()))):
                        x.append(v)
                columns = [part.column(0), pa.array(np.diff(offsets)), *(pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.string(), pa.int64())))]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_repeated"])

    kind = rows.schema["id"].dataType.simpleString()
    return held.mapInArrow(remove, f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_repeated long").withColumnRenamed("id", id_col)
