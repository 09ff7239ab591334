"""NumPy kernels over the UTF-8 bytes of many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

U = np.uint64
#: Odd multiplier of the positional hash, its inverse modulo 2**64, and the constants of the splitmix64 finalizer (fixed values).
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
#: Bytes of text that a kernel works on at once; a longer text is one piece of its own.
PIECE = 1 << 20

_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(30))
    x = x * U(MIX[0])
    x ^= x >> U(27)
    x *= U(MIX[1])
    x ^= x >> U(31)
    return x


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, PIECE + 1024)
        steps = np.full(size, base, U)
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        if n <= PIECE + 1024:
            _powers[base] = have
    return have[:n]


def text_pieces(batch: pa.RecordBatch, column: str = "text", limit: int = PIECE) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Consecutive rows of batch with at most limit bytes of text, or one row: (rows, bytes, offsets); a null text is empty."""
    texts = batch.column(batch.schema.get_field_index(column))
    ends = np.cumsum(np.asarray(pa.compute.fill_null(pa.compute.binary_length(texts), 0)).astype(np.int64))
    at = 0
    while at < len(ends):
        before = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + limit, "right")))
        part = texts.slice(at, to - at).cast(pa.large_string()).cast(pa.large_binary()).fill_null(b"")
        offsets = np.concatenate([[0], ends[at:to] - before]).astype(np.int64)
        first = np.frombuffer(part.buffers()[1], np.int64)[part.offset]
        data = np.frombuffer(part.buffers()[2], np.uint8)[first : first + offsets[-1]] if offsets[-1] else np.zeros(0, np.uint8)
        yield batch.slice(at, to - at), data, offsets
        at = to


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z."""
    return data + (((data >= 65) & (data <= 90)).astype(np.uint8) << 5)


SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True


def word_spans(data: np.ndarray, offsets: np.ndarray, gaps: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes outside gaps, never across texts, and each text's first word: (starts, ends, firsts)."""
    n = len(data)
    inside = ~gaps[data]
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    begin[cuts] = inside[cuts]
    end[cuts - 1] = inside[cuts - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def prefix_sums(data: np.ndarray, salt: int = 0) -> np.ndarray:
    """Sums of the bytes' values times powers of BASE, up to each place."""
    n = len(data)
    sums = np.zeros(n + 1, U)
    values = mix(data.astype(U) + U(257 + salt * 1009)) if n < 256 else mix(np.arange(256, dtype=U) + U(257 + salt * 1009))[data]
    np.cumsum(values * powers(BASE, n), out=sums[1:])
    return sums


def _hashes_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, salt: int) -> np.ndarray:
    sums = prefix_sums(data, salt)
    h = (sums[ends] - sums[starts]) * powers(INVERSE, len(data) + 1)[starts]
    return mix(h ^ ((ends - starts).astype(U) * U(MIX[1])))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit hash of each span, equal for equal bytes wherever they stand. starts must not fall.

    Long data are worked on in stretches of spans, so that memory is bounded by PIECE and the longest span.
    """
    if len(data) <= 4 * PIECE or not len(starts):
        return _hashes_of(data, starts, ends, salt)
    out = np.empty(len(starts), U)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(starts, starts[at] + PIECE)))
        a, b = int(starts[at]), int(ends[at:to].max())
        out[at:to] = _hashes_of(data[a:b], starts[at:to] - a, ends[at:to] - a, salt)
        at = to
    return out


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The distinct word shingles of each text, as sorted hashes: (hashes, offsets).

    Words are runs outside ASCII white space with A-Z lowered. A text of fewer words, but not none, has one shingle of them all.
    """
    low = lowered(data)
    starts, ends, firsts = word_spans(low, offsets)
    words = span_hashes(low, starts, ends)
    counts = np.diff(firsts)
    if not len(words):
        return np.zeros(0, U), np.zeros(len(counts) + 1, np.int64)
    whole = np.zeros(max(0, len(words) - size + 1), U)
    for k in range(size):
        whole += words[k : k + len(whole)] * U(pow(BASE, k + 1, 1 << 64))
    whole = mix(whole)
    parts, lengths = [], []
    for first, n in zip(firsts[:-1].tolist(), counts.tolist()):
        if n >= size:
            own = np.unique(whole[first : first + n - size + 1])
        elif n:
            short = words[first : first + n] * powers(BASE, n + 1)[1:]
            own = mix(short.sum(dtype=U, keepdims=True) + U(n))
        else:
            own = np.zeros(0, U)
        parts.append(own)
        lengths.append(len(own))
    return np.concatenate(parts), np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)


def merged_runs(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of half-open spans as maximal runs; touching spans join."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate([[True], s[1:] > e[:-1]])
    return s[new], e[np.concatenate([new[1:], [True]])]
