"""Messages between blocks of documents and buckets of names.

A block sends the sorted distinct names it holds to buckets, which are equal ranges
of the names. Only buckets that get a name get a message, so there are never more messages
than names, however many blocks and buckets there are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_U = np.uint64

_ZSTD = pa.Codec("zstd", compression_level=1)

MESSAGE = "bucket int, block int, a binary, b binary"
SCHEMA = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("a", pa.binary()), ("b", pa.binary())])


def messages(rows: list[tuple], schema: pa.Schema = SCHEMA) -> pa.Table:
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def planes(x: np.ndarray) -> bytes:
    """Numbers byte plane by byte plane: high planes are zero and compress away."""
    return np.ascontiguousarray(x.astype(np.uint64).view(np.uint8).reshape(-1, 8).T).tobytes()


def unplane(blob: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(8, -1).T).view(np.uint64).ravel()


def squeezed(blob: bytes) -> bytes:
    """Planes with their bytes coded by how often they occur, which the shuffle's own compression doesn't do."""
    return len(blob).to_bytes(8, "little") + _ZSTD.compress(blob, asbytes=True)


def opened(blob: bytes) -> bytes:
    return _ZSTD.decompress(blob[8:], int.from_bytes(blob[:8], "little"), asbytes=True)


def deltas(sorted_: np.ndarray) -> bytes:
    """Sorted numbers as planes of their differences."""
    return planes(np.diff(sorted_, prepend=_U(0)))


def sums(blob: bytes) -> np.ndarray:
    return np.cumsum(unplane(blob), dtype=np.uint64)


def ranges(names: np.ndarray, bits: int, buckets: int) -> list[tuple[int, int, int]]:
    """(bucket, start, end) of each bucket that holds some of the sorted names of `bits` bits."""
    if not len(names):
        return []
    bucket = (names >> _U(bits - 32)) * _U(buckets) >> _U(32)
    heads = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    return list(zip(bucket[heads].astype(np.int64).tolist(), heads.tolist(), [*heads[1:].tolist(), len(names)], strict=True))


def pack(*columns: np.ndarray) -> bytes:
    """Columns of equal lengths as planes."""
    return b"".join(map(planes, columns))


def unpack(blob: bytes, n: int) -> list[np.ndarray]:
    """The n columns of pack()."""
    size = len(blob) // n
    return [unplane(blob[k * size : (k + 1) * size]) for k in range(n)]
