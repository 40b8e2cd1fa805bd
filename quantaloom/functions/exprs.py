"""Column expressions of the quantizer, the codecs and the accounting; JVM-side throughout."""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from quantaloom.functions.params import QuantParams

#: Up to so many symbols a codec's expression is written out, one term each, and compiled; beyond it loops.
UNROLLED = 512
WORD = 0xFFFFFFFF


def doubles(values: np.ndarray) -> Column:
    return F.array(*(F.lit(float(v)) for v in values))


def longs(values) -> Column:
    return F.array(*(F.lit(int(v)).cast("long") for v in values))


def ints(values) -> Column:
    return F.array(*(F.lit(int(v)) for v in values))


def let(value: Column, use) -> Column:
    """``use(value)`` with the value made once, however often it is named; inside a lambda a column is made again each time.

    Not for what a Python function takes: Spark does not always recognise a function over nested lambdas again.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def vector_status(vector: Column, dim: int) -> Column:
    """ok, or why a row is no vector of the set: null, dim, non_finite."""
    odd = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.when(vector.isNull(), "null").when(F.size(vector) != dim, "dim").when(odd, "non_finite").otherwise("ok")


def strict_vector(vector: Column, dim: int) -> Column:
    """The vector; a row that is none ends the query. The check is part of the value, so no optimisation drops it."""
    status = vector_status(vector, dim)
    return F.when(status == "ok", vector).otherwise(F.raise_error(F.concat(F.lit("not a vector of this set: "), status)).cast("array<float>"))


def rotate(vector: Column, p: QuantParams) -> Column:
    signs = doubles(p.signs)
    return F.transform(ints(p.perm), lambda src, i: F.get(vector, src).cast("double") * F.get(signs, i))


def unrotate(rotated: Column, p: QuantParams) -> Column:
    """``rotate`` undone: coordinate c was moved to place inverse[c], with that place's sign. Give it a column, not an expression."""
    if p.dim <= UNROLLED:
        return F.array(*(F.get(rotated, F.lit(int(at))) * F.lit(float(p.signs[at])) for at in p.inverse))
    signs = doubles(p.signs[p.inverse])
    return let(rotated, lambda x: F.transform(ints(p.inverse), lambda at, i: F.get(x, at) * F.get(signs, i)))


def level(v: Column, p: QuantParams) -> Column:
    """Index of the nearest centroid, the lower of two as near; 0 for what is not finite, as no distance is smaller."""
    above = functools.reduce(lambda a, b: a + b, ((v > float(m)).cast("int") for m in p.midpoints))
    return F.when(F.isnan(v) | (F.abs(v) == float("inf")), F.lit(0)).otherwise(above)


def quantize(rotated: Column, p: QuantParams) -> Column:
    return F.transform(rotated, lambda v: level(v, p))


def dequantize(idx: Column, p: QuantParams) -> Column:
    """Values in rotated coordinates."""
    table = doubles(p.centroids)
    return F.transform(idx, lambda k: F.get(table, k))


def coordinate(idx: Column, p: QuantParams, c: int) -> Column:
    """One coordinate of the reconstruction, without the others."""
    at = int(p.inverse[c])
    return F.get(doubles(p.centroids), F.get(idx, F.lit(at))) * F.lit(float(p.signs[at]))


def distance(a: Column, b: Column) -> Column:
    squares = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda acc, v: acc + v))


def word_count(bits: int) -> int:
    return -(-bits // 32)


def _unrolled(dim: int) -> None:
    if dim > UNROLLED:
        raise ValueError(f"expressions are written out for up to {UNROLLED} symbols; use the arrow engine beyond")


def bitpack(idx: Column, dim: int, bits: int) -> Column:
    """Words of symbols, least significant bit first; symbols run over word ends, the last word is filled with zeros."""
    _unrolled(dim)
    words = []
    for w in range(word_count(dim * bits)):
        terms = []
        for i in range(32 * w // bits, min(dim, -(-32 * (w + 1) // bits))):
            shift = i * bits - 32 * w
            s = F.get(idx, F.lit(i)).cast("long")
            terms.append(F.shiftleft(s, shift) if shift >= 0 else F.shiftright(s, -shift))
        words.append(functools.reduce(lambda a, b: a.bitwiseOR(b), terms).bitwiseAND(F.lit(WORD)))
    return F.array(*words)


def unpack(words: Column, dim: int, bits: int) -> Column:
    """Symbols of words. Give it a column, not an expression: it is named for each symbol."""
    _unrolled(dim)
    mask, out = F.lit((1 << bits) - 1).cast("long"), []
    for i in range(dim):
        at, shift = divmod(i * bits, 32)
        low = F.shiftright(F.get(words, F.lit(at)), shift)
        if shift + bits > 32:
            low = low.bitwiseOR(F.shiftleft(F.get(words, F.lit(at + 1)), 32 - shift))
        out.append(low.bitwiseAND(mask).cast("int"))
    return F.array(*out)


def delta_xor(words: Column) -> Column:
    before = F.concat(F.array(F.lit(0).cast("long")), F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))))
    return F.zip_with(words, before, lambda w, b: w.bitwiseXOR(b))


def undo_delta_xor(words: Column) -> Column:
    start = F.struct(F.lit(0).cast("long").alias("last"), F.array().cast("array<bigint>").alias("all"))

    def step(acc: Column, w: Column) -> Column:
        now = acc["last"].bitwiseXOR(w)
        return F.struct(now.alias("last"), F.array_append(acc["all"], now).alias("all"))

    return F.aggregate(words, start, step, lambda acc: acc["all"])


@functools.lru_cache(maxsize=1)
def crc32c_table() -> tuple[int, ...]:
    """From the Castagnoli polynomial, reflected."""
    table = []
    for n in range(256):
        for _ in range(8):
            n = (n >> 1) ^ (0x82F63B78 if n & 1 else 0)
        table.append(n)
    return tuple(table)


def crc32c(words: Column, bit_count: Column) -> Column:
    """CRC-32C over the little-endian words and then the bit count. Spark's own crc32 has another polynomial."""
    table = longs(crc32c_table())
    parts = F.flatten(F.transform(F.array_append(words, bit_count.cast("long")), lambda w: F.array(*(F.shiftright(w, s).bitwiseAND(F.lit(255).cast("long")) for s in (0, 8, 16, 24)))))
    end = F.aggregate(parts, F.lit(WORD).cast("long"), lambda crc, b: F.get(table, crc.bitwiseXOR(b).bitwiseAND(F.lit(255).cast("long")).cast("int")).bitwiseXOR(F.shiftright(crc, 8)))
    return end.bitwiseXOR(F.lit(WORD).cast("long"))


def bits_to_bytes(bits: Column) -> Column:
    return F.ceil(bits / 8).cast("long")


def wire_bytes(written_bits: Column, valid_bits: Column) -> Column:
    """What a packet's payload takes on the wire: written bits where known (Huffman), else all valid bits."""
    return bits_to_bytes(F.coalesce(written_bits, valid_bits))


def codebook_bytes(bits: Column) -> Column:
    """Parent, left and right links of 2 * 2^bits nodes and the root, four bytes each."""
    return ((F.pow(F.lit(2.0), bits) * 6 + 1) * 4).cast("long")


def resident_bytes(word_count: Column, embedded_nodes: Column) -> Column:
    """The words in memory, and an embedded tree's three links a node, root and size."""
    tree = F.when(embedded_nodes.isNotNull(), (embedded_nodes * 3 + 2) * 4).otherwise(F.lit(0))
    return (word_count * 4 + tree).cast("long")


#: Statuses of a packet, in the order of the checks.
PACKET_STATUSES = ("dim", "bit_width", "word_count", "capacity", "word_bits_mismatch", "fixed_bits_mismatch", "crc_missing", "crc_mismatch")


def packet_status(checksum: Column | None = None) -> Column:
    """ok, or the first check that a packet (columns of the packet schema) fails. Nulls fail the check that they meet."""
    fails = lambda ok: ~F.coalesce(ok, F.lit(False))
    valid, words = F.col("valid_bits"), F.col("word_count")
    return (
        F.when(fails(F.col("dim") > 0), "dim")
        .when(fails(F.col("bit_width") >= 1), "bit_width")
        .when(fails((words > 0) & (F.size("payload_words") == words)), "word_count")
        .when(fails(valid <= words.cast("long") * 32), "capacity")
        .when(fails(words == F.ceil(valid / 32)), "word_bits_mismatch")
        .when(fails((F.col("encoding") == "huffman") | (valid == F.col("dim").cast("long") * F.col("bit_width"))), "fixed_bits_mismatch")
        .when(F.col("payload_crc32c").isNull(), "crc_missing")
        .when(fails(F.col("payload_crc32c") == (packet_crc() if checksum is None else checksum)), "crc_mismatch")
        .otherwise("ok")
    )


def packet_crc() -> Column:
    return crc32c(F.col("payload_words"), F.coalesce("written_bits", "valid_bits"))
