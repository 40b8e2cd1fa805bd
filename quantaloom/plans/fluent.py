"""A fluent builder over the operators, and their registration as SQL functions."""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantaloom.functions import huffman, kernels
from quantaloom.functions.params import QuantParams
from quantaloom.operators import codecs, policy, vectors
from quantaloom.sources.session import ship


@dataclass(frozen=True)
class VectorCodec:
    """Options of a quantizer; each setter gives a new builder. The order in which executors do the work is Spark's choice."""

    df: DataFrame
    column: str = "embedding"
    bits: int = 4
    seed_: int = 0
    qjl: bool = True
    entropy: bool = True
    mode: str = "strict"
    engine_: str = "arrow"
    huffman_: bool = False
    dim_: int | None = None

    def bit_width(self, bits: int) -> VectorCodec:
        QuantParams(1, bits)
        return replace(self, bits=bits)

    def seed(self, seed: int) -> VectorCodec:
        return replace(self, seed_=seed)

    def emit_qjl(self, on: bool) -> VectorCodec:
        return replace(self, qjl=on)

    def emit_entropy(self, on: bool) -> VectorCodec:
        return replace(self, entropy=on)

    def dim(self, dim: int) -> VectorCodec:
        return replace(self, dim_=dim)

    def audit(self) -> VectorCodec:
        return replace(self, mode="audit")

    def engine(self, engine: str) -> VectorCodec:
        if engine not in vectors.ENGINES:
            raise ValueError(f"engine must be one of {vectors.ENGINES}")
        return replace(self, engine_=engine)

    def experimental_huffman(self, on: bool = True) -> VectorCodec:
        return replace(self, huffman_=on)

    # Parameters and launches

    def params(self) -> QuantParams:
        """Of the given dim, or the first vector's."""
        dim = self.dim_
        if dim is None:
            first = self.df.where(F.col(self.column).isNotNull()).select(F.size(self.column).alias("n")).first()
            if first is None or not first["n"]:
                raise ValueError("there is no vector to take the dimension from")
            dim = first["n"]
        return QuantParams(dim, self.bits, self.seed_)

    def _rows(self, p: QuantParams) -> DataFrame:
        return vectors.checked(self.df, p.dim, self.column, self.mode)

    def quantize(self) -> DataFrame:
        p = self.params()
        return vectors.fused(self._rows(p), p, self.qjl, self.column, self.engine_)

    def pipeline(self) -> DataFrame:
        p = self.params()
        return codecs.pipeline(self._rows(p), p, self.qjl, self.entropy, self.column, self.engine_)

    def encode(self, entropy: bool) -> DataFrame:
        return self.emit_entropy(entropy).pipeline()

    def mse(self, rotated: bool = False) -> DataFrame:
        """The reconstruction from indices alone, in rotated coordinates if asked for."""
        p = self.params()
        return vectors.dequantize_mse(vectors.quantize_mse(self._rows(p), p, self.column, self.engine_), p, "mse", rotated).drop("idx")

    def prod(self) -> DataFrame:
        """The sign sketch of the residual."""
        p = self.params()
        return vectors.qjl_signs(self._rows(p), p, self.column, self.engine_)

    def reconstruct(self) -> DataFrame:
        p = self.params()
        return vectors.dequantize_prod(vectors.quantize_prod(self._rows(p), p, self.column, self.engine_), p)

    def validate(self, tolerance: float = 1e-6) -> DataFrame:
        p = self.params()
        return vectors.validate_outputs(vectors.fused(self._rows(p), p, self.qjl, self.column, self.engine_), p, tolerance, self.column)

    # Codecs

    def bitpack(self, indexed: DataFrame) -> DataFrame:
        return codecs.bitpack(indexed, self.params(), self.engine_)

    def delta_xor(self, packets: DataFrame) -> DataFrame:
        return codecs.delta_xor(packets)

    def decode(self, packets: DataFrame, tree: huffman.Tree | str | None = None) -> DataFrame:
        return codecs.decode(packets, self.params(), tree, self.mode, experimental_huffman=self.huffman_)

    decode_indices = decode

    def build_huffman_codebook(self, indexed: DataFrame) -> DataFrame:
        return codecs.build_codebook(indexed, self.params(), self.huffman_)

    def huffman(self, indexed: DataFrame, tree: huffman.Tree | str | None = None) -> DataFrame:
        return codecs.huffman_encode(indexed, self.params(), tree, self.huffman_)

    def huffman_with_policy(self, indexed: DataFrame, cadence: int, initial: DataFrame | None = None) -> DataFrame:
        return policy.encode_with_reuse(indexed, self.params(), cadence, experimental_huffman=self.huffman_, initial=initial)

    def huffman_auto(self, indexed: DataFrame) -> DataFrame:
        return policy.encode_auto(indexed, self.params(), experimental_huffman=self.huffman_)

    def decode_with_policy(self, packets: DataFrame, books: DataFrame) -> DataFrame:
        codecs.require_huffman(self.huffman_)
        return policy.decode_with_policy(packets, books, self.params(), self.mode)


def vector_codec(df: DataFrame, column: str = "embedding") -> VectorCodec:
    """``vector_codec(df).bit_width(4).seed(77).pipeline()``"""
    return VectorCodec(df, column)


def register_functions(spark: SparkSession, p: QuantParams, prefix: str = "vq_") -> list[str]:
    """Registers SQL functions of one parameter set: quantize, dequantize, signs, pack, unpack, crc32c."""
    ship(spark)
    projection = spark.sparkContext.broadcast(p.rotated_projection)

    @F.arrow_udf("array<int>")
    def quantize(x: pa.Array) -> pa.Array:
        v, given = kernels.matrix(x, p.dim)
        return kernels.lists(kernels.quantize(v, p)[0], given, pa.int32())

    @F.arrow_udf("array<double>")
    def dequantize(idx: pa.Array) -> pa.Array:
        k, given = kernels.matrix(idx, p.dim, "int64")
        return kernels.lists(kernels.dequantize(k, p), given, pa.float64())

    @F.arrow_udf("array<int>")
    def signs(x: pa.Array) -> pa.Array:
        v, given = kernels.matrix(x, p.dim)
        return kernels.lists(kernels.qjl(kernels.residual(v, kernels.quantize(v, p)[1], p), projection.value), given, pa.int32())

    @F.arrow_udf("array<bigint>")
    def pack(idx: pa.Array) -> pa.Array:
        k, given = kernels.matrix(idx, p.dim, "int64")
        return kernels.lists(kernels.pack(k, p.mse_bits), given, pa.int64())

    @F.arrow_udf("array<int>")
    def unpack(words: pa.Array) -> pa.Array:
        w, given = kernels.matrix(words, -(-p.dim * p.mse_bits // 32), "int64")
        return kernels.lists(kernels.unpack(w, p.dim, p.mse_bits), given, pa.int32())

    @F.arrow_udf("bigint")
    def crc32c(words: pa.Array) -> pa.Array:
        w, given = kernels.matrix(words, -(-p.dim * p.mse_bits // 32), "int64")
        return pa.array(kernels.crc32c(w, np.full(len(w), p.dim * p.mse_bits)), mask=~given)

    made = {"quantize": quantize, "dequantize": dequantize, "signs": signs, "pack": pack, "unpack": unpack, "crc32c": crc32c}
    for name, f in made.items():
        spark.udf.register(prefix + name, f)
    return [prefix + name for name in made]
