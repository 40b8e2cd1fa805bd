"""Vectors to indices and back. DataFrame in, DataFrame out; other columns pass through.

Two engines give the same rows. ``native``: Column expressions only. ``arrow``: numpy over Arrow batches, for the dense
projection and for wide vectors. A row that is no vector of the set (null, other length, not finite) ends the query in
strict mode; in audit mode it gets null results and its ``vector_status`` says why.
"""

from __future__ import annotations

import itertools

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantaloom.functions import exprs, kernels
from quantaloom.functions.params import QuantParams
from quantaloom.sources.session import ship

#: Query vectors of a block; more are searched in further blocks. A batch is scored against so many at once.
QUERIES_AT_ONCE, SCORED_AT_ONCE = 10_000, 1_000
#: Decimals of a score; scores equal in these are ranked by vec_id.
SCORE_DIGITS = 12
#: Coordinates up to which a dense product is written out in Column expressions to check another.
NATIVE_DIM = 64
ENGINES, MODES = ("native", "arrow"), ("strict", "audit")


def checked(df: DataFrame, dim: int, column: str = "embedding", mode: str = "strict") -> DataFrame:
    """Strict: the column, or the end of the query. Audit: null where unfit, and ``vector_status``."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    vector = F.col(column)
    if mode == "strict":
        return df.withColumn(column, exprs.strict_vector(vector, dim))
    df = df.withColumn("vector_status", exprs.vector_status(vector, dim))
    return df.withColumn(column, F.when(F.col("vector_status") == "ok", vector))


def rotate(df: DataFrame, p: QuantParams, column: str = "embedding", out: str = "rotated") -> DataFrame:
    return df.withColumn(out, exprs.rotate(F.col(column), p))


def unrotate(df: DataFrame, p: QuantParams, column: str = "rotated", out: str = "embedding") -> DataFrame:
    return df.withColumn(out, exprs.unrotate(F.col(column), p))


def quantize_mse(df: DataFrame, p: QuantParams, column: str = "embedding", engine: str = "native") -> DataFrame:
    """Adds ``idx``: the index of the nearest centroid of each rotated coordinate."""
    if engine == "native":
        return df.withColumn("idx", exprs.quantize(exprs.rotate(F.col(column), p), p))
    return df.withColumn("_q", _fused_udf(df, p, False)(F.col(column))).withColumn("idx", F.col("_q.idx")).drop("_q")


def dequantize_mse(df: DataFrame, p: QuantParams, out: str = "xhat", rotated: bool = False) -> DataFrame:
    """Adds the centroids that ``idx`` names, in the vector's own coordinates unless ``rotated``."""
    values = exprs.dequantize(F.col("idx"), p)
    return df.withColumn(out, values) if rotated else df.withColumn("_values", values).withColumn(out, exprs.unrotate(F.col("_values"), p)).drop("_values")


def coordinate(df: DataFrame, p: QuantParams, c: int, out: str = "value") -> DataFrame:
    """Adds coordinate ``c`` of the reconstruction without making the others."""
    if not 0 <= c < p.dim:
        raise ValueError("no such coordinate")
    return df.withColumn(out, exprs.coordinate(F.col("idx"), p, c))


def residual_norm(df: DataFrame, p: QuantParams, column: str = "embedding", out: str = "residual_norm") -> DataFrame:
    """Adds the length of the vector less its reconstruction; rotation does not change it."""
    return df.withColumn(out, exprs.distance(exprs.rotate(F.col(column), p), exprs.dequantize(F.col("idx"), p)))


def _fused_udf(df: DataFrame, p: QuantParams, emit_qjl: bool):
    ship(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(p.rotated_projection) if emit_qjl else None  # dim^2 doubles, whatever the rows

    @F.arrow_udf("struct<idx: array<int>, mse_rot: array<double>, qjl: array<int>, residual_norm: double>")
    def run(vectors: pa.Array) -> pa.Array:
        x, given = kernels.matrix(vectors, p.dim)
        idx, values = kernels.quantize(x, p)
        res = kernels.residual(x, values, p)
        signs = kernels.lists(kernels.qjl(res, shared.value), given, pa.int32()) if shared else pa.nulls(len(x), pa.list_(pa.int32()))
        norm = pa.array((res * res).sum(1) ** 0.5, pa.float64(), mask=~given)
        return pa.StructArray.from_arrays([kernels.lists(idx, given, pa.int32()), kernels.lists(values, given, pa.float64()), signs, norm], ["idx", "mse_rot", "qjl", "residual_norm"])

    return run


def fused(df: DataFrame, p: QuantParams, emit_qjl: bool = True, column: str = "embedding", engine: str = "arrow") -> DataFrame:
    """Adds idx, mse_rot (rotated coordinates), qjl (null unless asked for), residual_norm, dim, mse_bits, seed."""
    if engine not in ENGINES:
        raise ValueError(f"engine must be one of {ENGINES}")
    if engine == "arrow":
        df = df.withColumn("_q", _fused_udf(df, p, emit_qjl)(F.col(column)))
        df = df.select(*(c for c in df.columns if c != "_q"), "_q.idx", "_q.mse_rot", "_q.qjl", "_q.residual_norm")
    else:
        df = residual_norm(dequantize_mse(quantize_mse(df, p, column), p, "mse_rot", rotated=True), p, column)
        df = df.withColumn("qjl", _native_signs(F.zip_with(exprs.rotate(F.col(column), p), F.col("mse_rot"), lambda a, b: a - b), p) if emit_qjl else F.lit(None).cast("array<int>"))
    return df.withColumns({"dim": F.lit(p.dim), "mse_bits": F.lit(p.mse_bits), "seed": F.lit(p.seed).cast("long")})


def _native_dots(res: Column, p: QuantParams) -> Column:
    def dot(row: Column) -> Column:
        return F.aggregate(F.zip_with(res, row, lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v)

    return F.transform(F.array(*(exprs.doubles(row) for row in p.rotated_projection)), dot)


def _native_signs(res: Column, p: QuantParams) -> Column:
    return F.transform(_native_dots(res, p), lambda dot: F.when(F.isnan(dot), -1).when(dot >= 0, 1).otherwise(-1))


def qjl_signs(df: DataFrame, p: QuantParams, column: str = "embedding", engine: str = "arrow") -> DataFrame:
    """The sign sketch of the residual alone."""
    return fused(df, p, True, column, engine).drop("idx", "mse_rot", "residual_norm", "dim", "mse_bits", "seed")


def quantize_prod(df: DataFrame, p: QuantParams, column: str = "embedding", engine: str = "arrow") -> DataFrame:
    """Adds idx, qjl and residual_norm: all that an unbiased inner product needs."""
    return fused(df, p, True, column, engine).drop("mse_rot")


def dequantize_prod(df: DataFrame, p: QuantParams, out: str = "xhat") -> DataFrame:
    """Adds the reconstruction from idx, qjl and residual_norm."""
    ship(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(p.projection)

    @F.arrow_udf("array<double>")
    def run(idx: pa.Array, signs: pa.Array, norm: pa.Array) -> pa.Array:
        k, given = kernels.matrix(idx, p.dim, "int64")
        s, _ = kernels.matrix(signs, p.dim)
        return kernels.lists(kernels.dequantize_prod(k, s, norm.fill_null(0.0).to_numpy(zero_copy_only=False), p, shared.value), given, pa.float64())

    return df.withColumn(out, run("idx", "qjl", "residual_norm"))


def validate_outputs(df: DataFrame, p: QuantParams, tolerance: float = 1e-6, column: str = "embedding") -> DataFrame:
    """Adds ``valid``: whether mse_rot, and qjl where emitted, are what formulas of another kind than ``fused``'s give.

    Values by Column expressions. Signs up to ``NATIVE_DIM`` by Column expressions, beyond from the residual in the vector's
    own coordinates and the projection that is not rotated. A sign is open where the dot product is within ``tolerance`` of 0.
    """
    value = exprs.dequantize(exprs.quantize(exprs.rotate(F.col(column), p), p), p)
    near = F.forall(F.zip_with("mse_rot", value, lambda a, b: F.abs(a - b) <= tolerance), lambda ok: F.coalesce(ok, F.lit(False)))
    if p.dim <= NATIVE_DIM:
        dots = _native_dots(F.zip_with(exprs.rotate(F.col(column), p), value, lambda a, b: a - b), p)
    else:
        dots = _own_dots(df, p)(F.zip_with(column, exprs.unrotate(value, p), lambda a, b: a - b))
    df = df.withColumn("_dots", dots)
    same = F.forall(F.zip_with("qjl", "_dots", lambda sign, dot: (F.abs(dot) <= tolerance) | (sign == F.when(dot >= 0, 1).otherwise(-1))), lambda ok: F.coalesce(ok, F.lit(False)))
    valid = near & (F.size("mse_rot") == p.dim) & F.when(F.col("qjl").isNull(), True).otherwise(same & (F.size("qjl") == p.dim))
    return df.withColumn("valid", F.coalesce(valid, F.lit(False))).drop("_dots")


def _own_dots(df: DataFrame, p: QuantParams):
    ship(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(p.projection)  # dim^2 doubles, whatever the rows

    @F.arrow_udf("array<double>")
    def run(residual: pa.Array) -> pa.Array:
        x, given = kernels.matrix(residual, p.dim)
        return kernels.lists(x @ shared.value.T, given, pa.float64())

    return run


def inner_products(queries: DataFrame, packets: DataFrame, p: QuantParams, k: int = 10) -> DataFrame:
    """Approximate top-k: (query_id, vec_id, score) by inner product of queries with reconstructed packets.

    Queries (query_id, query) are searched in blocks of ``QUERIES_AT_ONCE``, each over all packets.
    """
    rows, out = queries.select("query_id", "query").toLocalIterator(), None
    while (some := list(itertools.islice(rows, QUERIES_AT_ONCE))) or out is None:
        part = _block_products([r["query_id"] for r in some], [list(r["query"]) for r in some], packets, p, k)
        out = part if out is None else out.unionByName(part)
    # Of each batch k rows a query are left, and the limit by rank is taken in each partition before the shuffle.
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _block_products(ids: list, vectors: list[list[float]], packets: DataFrame, p: QuantParams, k: int) -> DataFrame:
    ship(packets.sparkSession)
    shared = packets.sparkSession.sparkContext.broadcast((ids, vectors))  # a block of queries, not the table
    schema = "query_id long, vec_id long, score double"

    def run(batches):
        import numpy as np

        ids, vectors = shared.value
        if not ids:
            return
        q = np.array(vectors)
        for batch in batches:
            x, _ = kernels.matrix(batch.column("xhat"), p.dim)
            vec = batch.column("vec_id").to_numpy()
            for at in range(0, len(ids), SCORED_AT_ONCE):
                # A matrix product's last digits depend on a row's place in its batch; equal vectors must tie.
                scores = np.round(x @ q[at : at + SCORED_AT_ONCE].T, SCORE_DIGITS)
                by = np.broadcast_to(vec[:, None], scores.shape)
                top = np.lexsort((by, -scores), axis=0)[:k]  # of equal scores the smaller vec_id, as in the rank below
                columns = np.tile(ids[at : at + SCORED_AT_ONCE], len(top)), vec[top].ravel(), np.take_along_axis(scores, top, 0).ravel()
                yield pa.record_batch([pa.array(c) for c in columns], names=["query_id", "vec_id", "score"])

    return dequantize_prod(packets, p).select("vec_id", "xhat").mapInArrow(run, schema)
