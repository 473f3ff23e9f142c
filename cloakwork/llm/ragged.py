"""Ragged numpy arrays over Arrow strings: words, hashes and packed columns.

A batch of texts is handled as one byte buffer with offsets, so the cost of a
text is a few vector operations whatever its length, and an empty or null text
is an empty range.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; a longer single text is one chunk of its own.
CHUNK_BYTES = 1 << 20
CHUNK_ROWS = 4096

_U = np.uint64
#: Two seeds: hashes under both together have 128 bits.
SEED, SEED2 = _U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93)
#: Spans of more bytes are hashed by blake2b, one by one.
LONG_SPAN = 256
#: The bytes of a lane of eight that are kept where so many are left.
_LEFT = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def space_table() -> np.ndarray:
    """True for bytes of `[^\\x20\\x09-\\x0D]`."""
    t = np.ones(256, bool)
    t[[0x20, *range(0x09, 0x0E)]] = False
    return t


NOT_SPACE = space_table()


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, one to one: every input bit reaches every output bit."""
    x = x ^ (x >> _U(33))
    x *= _U(0xFF51AFD7ED558CCD)
    x ^= x >> _U(33)
    x *= _U(0xC4CEB9FE1A85EC53)
    x ^= x >> _U(33)
    return x


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: np.uint64 = SEED) -> np.ndarray:
    """A 64-bit hash of the bytes data[start:end] for each pair.

    Lanes of eight bytes are mixed in one after another, so nothing in the hash is linear in the
    content; spans of equal length up to eight bytes never collide.
    """
    starts, length = np.asarray(starts, np.int64), np.asarray(ends, np.int64) - starts
    h = mix(length.astype(np.uint64) * _U(0xA0761D6478BD642F) ^ seed)
    lanes = np.ndarray((len(data) + 1,), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))
    live, at = np.flatnonzero((length > 0) & (length <= LONG_SPAN)), 0
    while len(live):
        left = length[live] - at
        h[live] = mix(h[live] ^ (lanes[starts[live] + at] & _LEFT[np.minimum(left, 8)]))
        live, at = live[left > 8], at + 8
    long = np.flatnonzero(length > LONG_SPAN)
    if len(long):
        raw, key = memoryview(np.ascontiguousarray(data)), int(seed).to_bytes(8, "little")
        h[long] = [int.from_bytes(hashlib.blake2b(raw[s : s + n], digest_size=8, key=key).digest(), "little") for s, n in zip(starts[long].tolist(), length[long].tolist(), strict=True)]
    return h


def _joined(left: np.ndarray, right: np.ndarray, seed: np.uint64) -> np.ndarray:
    """A hash of two hashes, in this order."""
    return mix(left * _U(0x9FB21C651E98DF25) + mix(right ^ seed))


def window_hash(items: np.ndarray, starts: np.ndarray, n: int, seed: np.uint64 = SEED2) -> np.ndarray:
    """Hashes of items[start:start+n]: those of 1, 2, 4 ... items, of which n is made up."""
    starts = np.asarray(starts, np.int64)
    out, done, size, level = None, 0, 1, items
    while size <= n and len(starts):
        if n & size:
            part = level[starts + done]
            out = mix(part + _U(n * int(seed) & 0xFFFFFFFFFFFFFFFF)) if out is None else _joined(out, part, seed)
            done += size
        if 2 * size <= n:
            level = _joined(level[:-size], level[size:], seed)
        size *= 2
    return np.zeros(0, np.uint64) if out is None else out


def order_within(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The order that sorts the values of each text, texts one after another."""
    out, first = np.empty(len(values), np.int64), first_of(counts)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b > a:
            out[a:b] = values[a:b].argsort()
            out[a:b] += a
    return out


def buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    off = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def chunks(table, text: str = "text", size: int = CHUNK_BYTES, rows: int = CHUNK_ROWS) -> Iterator:
    """Slices of a batch or table with at most about `size` bytes of text and `rows` rows each."""
    if not table.num_rows:
        return
    lengths = pc.fill_null(pc.binary_length(table.column(text)), 0).to_numpy(zero_copy_only=False) if isinstance(table, pa.RecordBatch) else pc.fill_null(pc.binary_length(table.column(text)), 0).to_numpy()
    total, first = 0, 0
    for at, n in enumerate(lengths.tolist()):
        if total and total + n > size or at - first >= rows:
            yield table.slice(first, at - first)
            first, total = at, 0
        total += n
    yield table.slice(first, len(lengths) - first)


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray = NOT_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, counts): byte ranges of maximal runs of bytes in `table`, and words per text."""
    n, texts = len(data), len(offsets) - 1
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(texts, np.int64)
    is_word = table[data]
    cut = np.zeros(n + 1, bool)  # a text starts here
    cut[offsets[:-1]] = True
    start = is_word.copy()
    start[1:] &= ~is_word[:-1] | cut[1:n]
    end = is_word.copy()
    end[:-1] &= ~is_word[1:] | cut[1:n]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.diff(np.searchsorted(starts, offsets))


def first_of(counts: np.ndarray) -> np.ndarray:
    """Index of each text's first item, and the total at the end."""
    out = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=out[1:])
    return out


def window_starts(counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, item index) of each window of n items that lies in one text."""
    first, many = first_of(counts), np.maximum(counts - n + 1, 0)
    text = np.repeat(np.arange(len(counts)), many)
    return text, np.arange(many.sum()) - np.repeat(first_of(many)[:-1], many) + first[text]


def lower_ascii(data: np.ndarray) -> np.ndarray:
    upper = (data >= 65) & (data <= 90)
    return np.where(upper, data | 32, data)


def pack(*columns: np.ndarray) -> bytes:
    return b"".join(np.ascontiguousarray(c).tobytes() for c in columns)


def unpack(blob: bytes, *dtypes: str) -> list[np.ndarray]:
    """The columns of pack(), which have equal lengths."""
    kinds = [np.dtype(d) for d in dtypes]
    n, at, out = len(blob) // sum(k.itemsize for k in kinds), 0, []
    for k in kinds:
        out.append(np.frombuffer(blob, k, n, at))
        at += n * k.itemsize
    return out


def unpack_all(blobs, *dtypes: str) -> list[np.ndarray]:
    got = [unpack(b, *dtypes) for b in blobs]
    return [np.concatenate([g[i] for g in got]) if got else np.zeros(0, d) for i, d in enumerate(dtypes)]


def by_bucket(bucket: np.ndarray, *columns: np.ndarray) -> Iterator[tuple]:
    """(bucket, its rows' columns) in bucket order; rows keep their order."""
    if not len(bucket):
        return
    order = np.argsort(bucket, kind="stable")
    sorted_ = bucket[order]
    cuts = np.flatnonzero(np.diff(sorted_)) + 1
    for part in np.split(order, cuts):
        yield (int(bucket[part[0]]), *(c[part] for c in columns))
