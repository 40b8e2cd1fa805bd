"""The quantizer and the codecs over Arrow batches in numpy: dense algebra, and widths beyond written-out expressions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from quantaloom.functions.exprs import crc32c_table
from quantaloom.functions.params import QuantParams


def matrix(column: pa.Array, dim: int, kind=np.float64) -> tuple[np.ndarray, np.ndarray]:
    """(rows of ``dim`` values, which rows are given). A null row is zeros; any other length is refused."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    given = ~np.asarray(column.is_null())
    size = np.diff(np.asarray(column.offsets))
    if (size[given] != dim).any():
        raise ValueError(f"rows of {dim} values are expected")
    out = np.zeros((len(column), dim), kind)
    out[given] = np.asarray(column.drop_null().flatten()).reshape(-1, dim)
    return out, given


def lists(values: np.ndarray, given: np.ndarray | None = None, kind: pa.DataType | None = None) -> pa.Array:
    """Rows as a list array, null where not given."""
    rows, dim = values.shape
    ends = np.arange(rows + 1, dtype=np.int32) * dim
    mask = None if given is None or given.all() else pa.array(~given)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.ravel(), kind), mask=mask)


def quantize(x: np.ndarray, p: QuantParams) -> tuple[np.ndarray, np.ndarray]:
    """(index, value) in rotated coordinates of each row; what is not finite gets index 0."""
    rotated = x[:, p.perm] * p.signs
    idx = np.searchsorted(p.midpoints, rotated, "left")
    idx[~np.isfinite(rotated)] = 0
    return idx.astype(np.int32), p.centroids[idx]


def residual(x: np.ndarray, values: np.ndarray, p: QuantParams) -> np.ndarray:
    return x[:, p.perm] * p.signs - values


def qjl(res: np.ndarray, rotated_projection: np.ndarray) -> np.ndarray:
    """Signs of the projected residual; of what is no number, -1."""
    with np.errstate(invalid="ignore"):
        return np.where(res @ rotated_projection.T >= 0, 1, -1).astype(np.int32)


def dequantize(idx: np.ndarray, p: QuantParams) -> np.ndarray:
    out = np.empty(idx.shape)
    out[:, p.perm] = p.centroids[idx] * p.signs
    return out


def dequantize_prod(idx: np.ndarray, signs: np.ndarray, norm: np.ndarray, p: QuantParams, projection: np.ndarray) -> np.ndarray:
    """The centroids, and the sketch's unbiased estimate of the residual."""
    return dequantize(idx, p) + (np.sqrt(np.pi / 2) * norm / p.dim)[:, None] * (signs @ projection)


def pack(idx: np.ndarray, bits: int) -> np.ndarray:
    rows, dim = idx.shape
    flat = (idx[:, :, None].astype(np.uint32) >> np.arange(bits, dtype=np.uint32) & 1).astype(np.uint8).reshape(rows, dim * bits)
    filled = np.zeros((rows, -(-dim * bits // 32) * 32), np.uint8)
    filled[:, : dim * bits] = flat
    return np.packbits(filled, axis=1, bitorder="little").view("<u4").astype(np.int64)


def unpack(words: np.ndarray, dim: int, bits: int) -> np.ndarray:
    flat = np.unpackbits(words.astype("<u4").view(np.uint8), axis=1, bitorder="little")[:, : dim * bits]
    return (flat.reshape(len(words), dim, bits).astype(np.int32) << np.arange(bits)).sum(2, dtype=np.int32)


def delta_xor(words: np.ndarray) -> np.ndarray:
    out = words.copy()
    out[:, 1:] ^= words[:, :-1]
    return out


def undo_delta_xor(words: np.ndarray) -> np.ndarray:
    return np.bitwise_xor.accumulate(words, axis=1)


def crc32c(words: np.ndarray, bit_count: np.ndarray) -> np.ndarray:
    table = np.array(crc32c_table(), np.uint32)
    raw = np.concatenate([words, bit_count[:, None]], 1).astype("<u4").view(np.uint8)
    crc = np.full(len(words), 0xFFFFFFFF, np.uint32)
    for at in range(raw.shape[1]):
        crc = table[(crc ^ raw[:, at]) & np.uint32(255)] ^ (crc >> np.uint32(8))
    return (crc ^ np.uint32(0xFFFFFFFF)).astype(np.int64)
