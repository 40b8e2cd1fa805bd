"""One query for each operator over the embeddings table, and its DuckDB twin where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantaloom.functions import exprs, huffman
from quantaloom.functions.params import QuantParams
from quantaloom.operators import codecs, policy, vectors
from quantaloom.plans.oracle import Twins, crc32c_of
from quantaloom.sources.vectors import read_vectors, synthetic_vectors

P = QuantParams(64, 4, 77)
#: Attention shapes of four public models: key-value heads, head width, layers.
KV_MODELS = [("Llama-3.1-8B", 8, 128, 32), ("Llama-3.1-70B", 8, 128, 80), ("Mistral-7B-v0.1", 8, 128, 32), ("Qwen2.5-7B", 4, 128, 28)]
#: Runs of a sweep: setting, trial, rows a second.
SWEEP = [(s, t, float(1000 * s % 7919 + 37 * t % 101)) for s in (1, 2, 4, 8, 16, 32, 64) for t in (1, 2, 3)]
CADENCE = 7

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
T = Twins(P)


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.checked(read_vectors(spark, f"{sf_dir}/embeddings.parquet"), P.dim)


def indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.quantize_mse(embeddings(spark, sf_dir), P).select("vec_id", "label", "idx")


def packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codecs.bitpack(indexed(spark, sf_dir), P)


def long_form(df: DataFrame, column: str, place: str, value: str) -> DataFrame:
    # The outer form: for the other the optimizer infers a filter on the array, and pushes all that makes it below.
    return df.select("vec_id", F.posexplode_outer(column).alias(place, value))


# Parameters


@query("SELECT bits, k, round(c, 9) AS c FROM (" + " UNION ALL ".join(f"SELECT {b} AS bits, unnest(range({1 << b})) AS k, unnest([{', '.join(repr(float(c)) for c in QuantParams(64, b + 1).centroids)}]) AS c" for b in range(1, 6)) + ")")
def centroid_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(b, k, float(c)) for b in range(1, 6) for k, c in enumerate(QuantParams(64, b + 1).centroids)]
    return spark.createDataFrame(rows, "bits int, k long, c double").withColumn("c", F.round("c", 9))


@query(T.sql("SELECT coord, src, CAST(sign AS INTEGER) AS sign FROM perm", "perm"))
def signed_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(i, int(s), int(x)) for i, (s, x) in enumerate(zip(P.perm, P.signs, strict=True))], "coord long, src int, sign int")


@query(T.sql("SELECT CAST(src AS BIGINT) AS coord, coord AS at FROM perm", "perm"))
def inverse_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(i, int(a)) for i, a in enumerate(P.inverse)], "coord long, at long")


@query(f"SELECT row, round(sum(p * CASE WHEN r % 2 = 0 THEN 1 ELSE -1 END), 9) AS checksum FROM ({T.parts['proj']}) GROUP BY row")
def rotated_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projection joined with the permutation: P[row, perm[r]] * sign[r]."""
    flat = spark.createDataFrame([(i // P.dim, i % P.dim, float(v)) for i, v in enumerate(P.projection.ravel())], "row long, col int, v double")
    perm = signed_permutation(spark, sf_dir)
    moved = flat.join(F.broadcast(perm), F.col("col") == F.col("src")).select("row", F.col("coord").alias("r"), (F.col("v") * F.col("sign")).alias("p"))
    return moved.groupBy("row").agg(F.round(F.sum(F.when(F.col("r") % 2 == 0, F.col("p")).otherwise(-F.col("p"))), 9).alias("checksum"))


# Pointwise


@query(T.sql("SELECT vec_id, CAST(coord AS INTEGER) AS coord, round(v, 6) AS value FROM rot", "rot"))
def rotate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long_form(vectors.rotate(embeddings(spark, sf_dir), P), "rotated", "coord", "value").withColumn("value", F.round("value", 6))


@query("SELECT vec_id, CAST(i AS INTEGER) AS coord, round(CAST(embedding[i + 1] AS DOUBLE), 6) AS value FROM embeddings, (SELECT unnest(range(64)) AS i)")
def unrotate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rotated and back: the input."""
    df = vectors.unrotate(vectors.rotate(embeddings(spark, sf_dir), P), P)
    return long_form(df, "embedding", "coord", "value").withColumn("value", F.round("value", 6))


@query(T.sql("SELECT vec_id, CAST(coord AS INTEGER) AS coord, idx FROM q", "q"))
def quantize_mse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long_form(indexed(spark, sf_dir), "idx", "coord", "idx")


@query(T.sql("SELECT vec_id, CAST(coord AS INTEGER) AS coord, idx FROM q", "q"))
def quantize_mse_arrow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long_form(vectors.quantize_mse(embeddings(spark, sf_dir), P, engine="arrow").select("vec_id", "idx"), "idx", "coord", "idx")


@query(T.sql("SELECT vec_id, src AS coord, round(sign * c, 9) AS value FROM deq", "deq"))
def dequantize_mse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long_form(vectors.dequantize_mse(indexed(spark, sf_dir), P), "xhat", "coord", "value").withColumn("value", F.round("value", 9))


@query(T.sql("SELECT vec_id, round(sign * c, 9) AS value FROM deq WHERE src = 5", "deq"))
def one_coordinate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.coordinate(indexed(spark, sf_dir), P, 5).select("vec_id", F.round("value", 9).alias("value"))


@query(T.sql("SELECT vec_id, round(residual_norm, 9) AS residual_norm FROM norm", "norm"))
def residual_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.residual_norm(vectors.quantize_mse(embeddings(spark, sf_dir), P), P).select("vec_id", F.round("residual_norm", 9).alias("residual_norm"))


@query(T.sql("SELECT label, count(*) AS n, round(avg(e), 9) AS mse, CAST(sum(24) AS BIGINT) AS wire_bytes FROM (SELECT vec_id, label, sum(res * res) AS e FROM deq GROUP BY vec_id, label) GROUP BY label", "deq"))
def mse_distortion_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: distortion and packed size by label."""
    df = vectors.residual_norm(vectors.quantize_mse(embeddings(spark, sf_dir), P), P)
    size = exprs.bits_to_bytes(F.lit(P.dim * P.mse_bits))
    return df.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("residual_norm") ** 2), 9).alias("mse"), F.sum(size).alias("wire_bytes"))


# Dense


@query(T.sql("SELECT vec_id, CAST(row AS INTEGER) AS row, sign FROM sgn", "sgn"))
def qjl_signs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long_form(vectors.qjl_signs(embeddings(spark, sf_dir), P), "qjl", "row", "sign")


@query(T.sql("SELECT vec_id, row, round(dot, 6) AS dot FROM dots", "dots"))
def project_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sketch's dot products as a join with the projection and a sum: the relational form."""
    df = vectors.dequantize_mse(vectors.quantize_mse(embeddings(spark, sf_dir), P), P, "v", rotated=True)
    res = F.zip_with(exprs.rotate(F.col("embedding"), P), F.col("v"), lambda a, b: a - b)
    proj = spark.createDataFrame([(i // P.dim, i % P.dim, float(v)) for i, v in enumerate(P.rotated_projection.ravel())], "row long, r int, p double")
    flat = df.select("vec_id", F.posexplode_outer(res).alias("r", "res"))
    return flat.join(F.broadcast(proj), "r").groupBy("vec_id", "row").agg(F.round(F.sum(F.col("p") * F.col("res")), 6).alias("dot"))


PROD = "SELECT vec_id, string_agg(CAST(idx AS VARCHAR), ',' ORDER BY coord) AS idx FROM q GROUP BY vec_id"


@query(T.sql(f"SELECT i.vec_id, i.idx, s.qjl, round(residual_norm, 9) AS residual_norm, 64 AS dim, 3 AS mse_bits, CAST(77 AS BIGINT) AS seed FROM ({PROD}) i JOIN (SELECT vec_id, string_agg(CAST(sign AS VARCHAR), ',' ORDER BY row) AS qjl FROM sgn GROUP BY vec_id) s USING (vec_id) JOIN norm USING (vec_id)", "sgn", "norm"))
def quantize_prod(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = vectors.quantize_prod(embeddings(spark, sf_dir).select("vec_id", "embedding"), P)
    return df.select("vec_id", F.array_join("idx", ",").alias("idx"), F.array_join("qjl", ",").alias("qjl"), F.round("residual_norm", 9).alias("residual_norm"), "dim", "mse_bits", "seed")


@query(T.sql("SELECT d.vec_id, d.src AS coord, round(d.sign * (d.c + sqrt(pi() / 2) * n.residual_norm / 64 * s.back), 6) AS value FROM deq d JOIN norm n USING (vec_id) JOIN (SELECT vec_id, r, sum(p * sign) AS back FROM sgn JOIN proj USING (row) GROUP BY vec_id, r) s ON s.vec_id = d.vec_id AND s.r = d.coord", "sgn", "norm"))
def dequantize_prod(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = vectors.dequantize_prod(vectors.quantize_prod(embeddings(spark, sf_dir).select("vec_id", "embedding"), P), P)
    return long_form(df, "xhat", "coord", "value").withColumn("value", F.round("value", 6))


@query("SELECT vec_id, vec_id % 3 = 0 AS valid FROM embeddings")
def validate_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the rows as they are, a third with one sign turned, a third with one value moved."""
    df = vectors.fused(embeddings(spark, sf_dir), P)
    third = F.col("vec_id") % 3
    turned = F.transform("qjl", lambda s, i: F.when((i == 5) & (third == 1), -s).otherwise(s))
    moved = F.transform("mse_rot", lambda v, i: F.when((i == 9) & (third == 2), v + 0.001).otherwise(v))
    return vectors.validate_outputs(df.withColumns({"qjl": turned, "mse_rot": moved}), P).select("vec_id", "valid")


@query(T.sql("SELECT vec_id, round(sum(c), 9) AS mse_rot_sum, CAST(sum(idx) AS BIGINT) AS idx_sum, CAST(NULL AS VARCHAR) AS qjl FROM deq GROUP BY vec_id", "deq"))
def fused_without_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = lambda c: F.aggregate(F.col(c), F.lit(0.0), lambda a, v: a + v)
    df = vectors.fused(embeddings(spark, sf_dir), P, emit_qjl=False, engine="native")
    return df.select("vec_id", F.round(total("mse_rot"), 9).alias("mse_rot_sum"), total("idx").cast("long").alias("idx_sum"), F.array_join("qjl", ",").alias("qjl"))


# Codecs


WORDS = "SELECT vec_id, CAST(w AS INTEGER) AS w, word FROM "


@query(T.sql(WORDS + "words", "words"))
def bitpack_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long_form(packed(spark, sf_dir), "payload_words", "w", "word")


@query(T.sql(WORDS + "words", "words"))
def bitpack_words_arrow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long_form(codecs.bitpack(indexed(spark, sf_dir), P, "arrow"), "payload_words", "w", "word")


@query(T.sql("SELECT vec_id, CAST(coord AS INTEGER) AS coord, idx FROM q", "q"))
def unpack_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long_form(codecs.decode(packed(spark, sf_dir), P), "idx", "coord", "idx")


@query(T.sql("SELECT vec_id, CAST(coord AS INTEGER) AS coord, idx FROM q", "q"))
def unpack_indices_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By Column expressions only, through delta-xor and back."""
    return long_form(codecs.decode(codecs.delta_xor(packed(spark, sf_dir), "native"), P, engine="native"), "idx", "coord", "idx")


@query(T.sql(WORDS + "xored", "xored"))
def delta_xor_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long_form(codecs.delta_xor(packed(spark, sf_dir)), "payload_words", "w", "word")


@query(T.sql("SELECT vec_id, CAST(coord AS INTEGER) AS coord, idx FROM q", "q"))
def delta_xor_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long_form(codecs.decode(codecs.delta_xor(packed(spark, sf_dir)), P), "idx", "coord", "idx")


@query(T.sql(f"SELECT vec_id, {crc32c_of('b')} AS payload_crc32c FROM bytes", "bytes"))
def crc32c(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(spark, sf_dir).select("vec_id", "payload_crc32c")


MUTATIONS = {
    "none": {}, "dim": {"dim": "0"}, "bit_width": {"bit_width": "0"}, "word_count": {"word_count": "0"}, "capacity": {"valid_bits": "999"}, "word_bits_mismatch": {"valid_bits": "100"},
    "fixed_bits_mismatch": {"valid_bits": "valid_bits - 1"}, "crc_missing": {"payload_crc32c": "cast(null as bigint)"}, "crc_mismatch": {"payload_crc32c": "payload_crc32c ^ 1"},
}


@query("SELECT m.mutation, CASE WHEN m.mutation = 'none' THEN 'ok' ELSE m.mutation END AS status, count(*) AS n FROM embeddings, (SELECT unnest([" + ", ".join(f"'{m}'" for m in MUTATIONS) + "]) AS mutation) m GROUP BY m.mutation")
def packet_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every check refuses the packets that break it, and no others."""
    base, out = packed(spark, sf_dir), None
    for name, changes in MUTATIONS.items():
        part = base.withColumns({c: F.expr(e).cast(base.schema[c].dataType) for c, e in changes.items()}).withColumn("mutation", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return codecs.with_status(out).groupBy("mutation", "status").agg(F.count(F.lit(1)).alias("n"))


@query(T.sql("SELECT vec_id, string_agg(CAST(word AS VARCHAR), ',' ORDER BY w) AS words, 'delta_xor' AS encoding FROM xored GROUP BY vec_id", "xored"))
def packet_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = codecs.pipeline(embeddings(spark, sf_dir), P, emit_qjl=True, entropy=True)
    return df.select("vec_id", F.array_join("payload_words", ",").alias("words"), "encoding")


@query(T.sql("SELECT vec_id, string_agg(CAST(word AS VARCHAR), ',' ORDER BY w) AS words, 'bitpacked' AS encoding FROM words GROUP BY vec_id", "words"))
def packet_pipeline_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = codecs.pipeline(embeddings(spark, sf_dir), P, emit_qjl=False)
    return df.select("vec_id", F.array_join("payload_words", ",").alias("words"), "encoding")


# Huffman


@query(T.sql("SELECT vec_id, CAST(symbol AS INTEGER) AS symbol, n FROM hist", "hist"))
def symbol_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codecs.symbol_histogram(indexed(spark, sf_dir), P, ["vec_id"])


def own_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codecs.build_codebook(indexed(spark, sf_dir), P, True)


@query(T.sql("SELECT vec_id, CAST(symbol AS INTEGER) AS symbol, code FROM code", "code"))
def huffman_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The code of each symbol in each vector's own tree, read off the links: up from a leaf, at most levels - 1 steps."""
    df = own_codes(spark, sf_dir).select("vec_id", "tree", F.explode(F.sequence(F.lit(0), F.lit((1 << P.mse_bits) - 1))).alias("symbol"))
    start = F.struct(F.col("symbol").cast("long").alias("node"), F.lit("").alias("code"))

    def step(acc, _):
        up = F.get(F.col("tree.parent"), acc["node"].cast("int"))
        bit = F.when(F.get(F.col("tree.right"), up.cast("int")) == acc["node"], "1").otherwise("0")
        return F.when(acc["node"] == F.col("tree.root"), acc).otherwise(F.struct(up.alias("node"), F.concat(bit, acc["code"]).alias("code")))

    code = F.aggregate(F.sequence(F.lit(1), F.lit((1 << P.mse_bits) - 1)), start, step, lambda acc: acc["code"])
    return df.select("vec_id", "symbol", code.alias("code"))


@query(T.sql("SELECT vec_id, CAST(sum(length(code)) AS BIGINT) AS written_bits, reverse(rpad(string_agg(code, '' ORDER BY coord), 512, '0')) AS payload FROM q JOIN code USING (vec_id) WHERE idx = symbol GROUP BY vec_id", "code"))
def huffman_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The payload as a row of binary digits, the first bit last."""
    df = codecs.huffman_encode(indexed(spark, sf_dir), P, experimental_huffman=True)
    digits = F.array_join(F.reverse(F.transform("payload_words", lambda w: F.lpad(F.conv(w.cast("string"), 10, 2), 32, "0"))), "")
    return df.select("vec_id", "written_bits", digits.alias("payload"))


@query(T.sql("SELECT vec_id, CAST(coord AS INTEGER) AS coord, idx FROM q", "q"))
def huffman_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = codecs.huffman_encode(indexed(spark, sf_dir), P, experimental_huffman=True)
    return long_form(codecs.decode(df, P, experimental_huffman=True), "idx", "coord", "idx")


@query(T.sql("SELECT vec_id, CAST(coord AS INTEGER) AS coord, idx FROM q", "q"))
def huffman_shared_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One tree for all vectors, from no counts at all: still every symbol has a code."""
    tree = huffman.build_tree([0] * (1 << P.mse_bits))
    df = codecs.huffman_encode(indexed(spark, sf_dir), P, tree, True)
    return long_form(codecs.decode(df, P, tree, experimental_huffman=True), "idx", "coord", "idx")


# Accounting


@query(T.sql("SELECT * FROM (SELECT 'bitpacked' AS encoding, vec_id, CAST(24 AS BIGINT) AS wire_bytes, CAST(24 AS BIGINT) AS resident_bytes, CAST(NULL AS BIGINT) AS codebook_bytes FROM embeddings UNION ALL SELECT 'huffman', vec_id, CAST(ceil(sum(length(code)) / 8) AS BIGINT), CAST(64 + 200 AS BIGINT), CAST(196 AS BIGINT) FROM q JOIN code USING (vec_id) WHERE idx = symbol GROUP BY vec_id)", "code"))
def packet_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes on the wire, in memory (a tree of 16 nodes embedded) and of a codebook."""
    both = packed(spark, sf_dir).unionByName(codecs.huffman_encode(indexed(spark, sf_dir), P, experimental_huffman=True))
    return codecs.accounting(both).select("encoding", "vec_id", "wire_bytes", "resident_bytes", "codebook_bytes")


@query("SELECT unnest(range(1, 9)) AS bits, unnest([52, 100, 196, 388, 772, 1540, 3076, 6148]) AS codebook_bytes".replace("range(1, 9)", "CAST(range(1, 9) AS BIGINT[])"))
def codebook_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(1, 9).select(F.col("id").alias("bits"), exprs.codebook_bytes(F.col("id")).alias("codebook_bytes")).withColumn("codebook_bytes", F.col("codebook_bytes").cast("int"))


@query("SELECT model, 2 * h * w AS dim, layers * 2 * h * w * 2 AS kv_bytes_per_token, round(100 * (1 - ceil(2 * h * w * 3 / 8) / (2 * h * w * 2.0)), 6) AS saved_percent, round(100 * (1 - ceil(2 * h * w * 3 / 8) / (2 * h * w * 4.0)), 6) AS saved_of_words_percent FROM (VALUES " + ", ".join(f"('{m}', {h}, {w}, {n})" for m, h, w, n in KV_MODELS) + ") t(model, h, w, layers)")
def kv_model_sizing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A token's keys and values at 16 bits, and what 3-bit indices save of that and of 32-bit index buffers."""
    df = spark.createDataFrame(KV_MODELS, "model string, h int, w int, layers int").withColumn("dim", 2 * F.col("h") * F.col("w"))
    wire = exprs.bits_to_bytes(F.col("dim") * P.mse_bits)
    save = lambda of: F.round(100 * (1 - wire / (F.col("dim") * of)), 6)
    return df.select("model", "dim", (F.col("layers") * F.col("dim") * 2).alias("kv_bytes_per_token"), save(2).alias("saved_percent"), save(4).alias("saved_of_words_percent"))


@query(T.sql("SELECT label, count(*) AS n, round(avg(b), 6) AS huffman_bytes, round(100 * (1 - avg(b) / 24), 6) AS saved_percent FROM (SELECT q.vec_id, q.label, ceil(sum(length(code)) / 8) AS b FROM q JOIN code ON code.vec_id = q.vec_id AND symbol = idx GROUP BY q.vec_id, q.label) GROUP BY label", "code"))
def codec_savings(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = codecs.accounting(codecs.huffman_encode(indexed(spark, sf_dir), P, experimental_huffman=True))
    mean = F.avg("wire_bytes")
    return df.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(mean, 6).alias("huffman_bytes"), F.round(100 * (1 - mean / exprs.bits_to_bytes(F.lit(P.dim * P.mse_bits))), 6).alias("saved_percent"))


RUNS = ", ".join(f"({s}, {t}, {q!r})" for s, t, q in SWEEP)


@query(f"SELECT setting, median(qps) AS median_qps, avg(qps) AS mean_qps FROM (VALUES {RUNS}) t(setting, trial, qps) GROUP BY setting")
def median_qps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(SWEEP, "setting int, trial int, qps double").groupBy("setting").agg(F.median("qps").alias("median_qps"), F.avg("qps").alias("mean_qps"))


@query(f"SELECT setting, median_qps FROM (SELECT setting, median(qps) AS median_qps FROM (VALUES {RUNS}) t(setting, trial, qps) GROUP BY setting) ORDER BY median_qps DESC, setting LIMIT 1")
def autotune_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best setting; of equal ones the first."""
    return median_qps(spark, sf_dir).orderBy(F.desc("median_qps"), "setting").select("setting", "median_qps").limit(1)


# Policies: a stream for each label, in the order of vec_id


def stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indexed(spark, sf_dir).select("vec_id", F.col("label").alias("stream_key"), F.col("vec_id").alias("seq"), "idx")


@query(f"SELECT vec_id, (row_number() OVER w - 1) % {CADENCE} AS tokens, (row_number() OVER w - 1) % {CADENCE} = 0 AS rebuilt, (row_number() OVER w - 1) // {CADENCE} + 1 AS generation FROM embeddings WINDOW w AS (PARTITION BY label ORDER BY vec_id)")
def reuse_policy_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = policy.reuse_epochs(stream(spark, sf_dir).withColumn("bit_width", F.lit(P.mse_bits)), CADENCE)
    return df.select("vec_id", "tokens", "rebuilt", "generation")


@query(T.sql(f"SELECT e.vec_id, CAST(sum(length(code)) AS BIGINT) AS written_bits FROM (SELECT vec_id, first_value(vec_id) OVER (PARTITION BY label, g ORDER BY vec_id) AS book FROM (SELECT vec_id, label, (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1) // {CADENCE} AS g FROM embeddings)) e JOIN q ON q.vec_id = e.vec_id JOIN code ON code.vec_id = e.book AND symbol = idx GROUP BY e.vec_id", "code"))
def reuse_policy_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.encode_with_reuse(stream(spark, sf_dir), P, CADENCE, experimental_huffman=True).select("vec_id", "written_bits")


@query(T.sql("SELECT vec_id, CAST(24 AS BIGINT) AS fixed_bytes, b AS huffman_bytes, greatest(0, 24 - b) AS saved, CAST(CASE WHEN b >= 24 THEN 1 ELSE least(256, greatest(1, ceil(196 / (24 - b)))) END AS INTEGER) AS cadence FROM (SELECT q.vec_id, CAST(ceil(sum(length(code)) / 8) AS BIGINT) AS b FROM q JOIN code ON code.vec_id = q.vec_id AND symbol = idx GROUP BY q.vec_id)", "code"))
def auto_cadence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.auto_cadence(indexed(spark, sf_dir), P).select("vec_id", "fixed_bytes", "huffman_bytes", "saved", "cadence")


@query(T.sql("SELECT vec_id, CAST(coord AS INTEGER) AS coord, idx FROM q", "q"))
def policy_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    packets = policy.encode_with_reuse(stream(spark, sf_dir), P, CADENCE, experimental_huffman=True)
    books = policy.registry(stream(spark, sf_dir), P, CADENCE)
    return long_form(policy.decode_with_policy(packets, books, P), "idx", "coord", "idx")


@query(f"SELECT CASE i WHEN 0 THEN 'ok' WHEN 1 THEN 'policy_id' WHEN 2 THEN 'generation' WHEN 3 THEN 'fingerprint' ELSE 'crc_mismatch' END AS status, count(*) AS n FROM (SELECT vec_id % 5 AS i FROM embeddings) GROUP BY i")
def policy_decode_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fifth of the packets each: whole; of another policy; of an unknown generation; with another tag; with a flipped bit."""
    packets = policy.encode_with_reuse(stream(spark, sf_dir), P, CADENCE, experimental_huffman=True)
    i = F.col("vec_id") % 5
    packets = packets.withColumns({
        "policy_id": F.when(i == 1, -F.col("policy_id")).otherwise(F.col("policy_id")), "codebook_generation": F.when(i == 2, F.col("codebook_generation") + 100_000).otherwise(F.col("codebook_generation")),
        "codebook_fingerprint": F.when(i == 3, F.lit("0" * 64)).otherwise(F.col("codebook_fingerprint")), "payload_words": F.when(i == 4, F.transform("payload_words", lambda w, k: F.when(k == 0, w.bitwiseXOR(F.lit(1).cast("long"))).otherwise(w))).otherwise(F.col("payload_words")),
    })
    return policy.policy_status(packets, policy.registry(stream(spark, sf_dir), P, CADENCE)).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query(T.sql("SELECT CASE WHEN any_value(label) < 5 THEN 'low' ELSE 'high' END AS part, CAST(cadence AS INTEGER) AS cadence, count(*) AS n FROM (SELECT label, first_value(cadence) OVER (PARTITION BY label ORDER BY vec_id) AS cadence FROM (SELECT q.vec_id, q.label, CASE WHEN ceil(sum(length(code)) / 8) >= 24 THEN 1 ELSE least(256, greatest(1, ceil(196 / (24 - ceil(sum(length(code)) / 8))))) END AS cadence FROM q JOIN code ON code.vec_id = q.vec_id AND symbol = idx GROUP BY q.vec_id, q.label)) GROUP BY label < 5, cadence", "code"))
def auto_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = policy.encode_auto(stream(spark, sf_dir), P, experimental_huffman=True)
    return df.groupBy(F.when(F.col("stream_key") < 5, "low").otherwise("high").alias("part"), "cadence").agg(F.count(F.lit(1)).alias("n"))


#: Streams that change width every 20 vectors and back, are invalidated before each vector whose id ends in 35, and of which
#: the even ones begin with a book of the first width.
WIDE = QuantParams(64, 5, 77)


def mixed_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = embeddings(spark, sf_dir).select("vec_id", F.col("label").alias("stream_key"), (F.col("vec_id") * 2 + 1).alias("seq"), "embedding")
    wide = (F.col("vec_id") / 20).cast("long") % 2 == 1
    both = vectors.quantize_mse(df.where(~wide), P).withColumn("bit_width", F.lit(P.mse_bits)).unionByName(vectors.quantize_mse(df.where(wide), WIDE).withColumn("bit_width", F.lit(WIDE.mse_bits)))
    both = both.select("vec_id", "stream_key", "seq", "idx", F.lit(P.dim).alias("dim"), "bit_width", F.lit(None).cast("string").alias("control"))
    stops = df.where("vec_id % 100 = 35").select("vec_id", "stream_key", (F.col("seq") - 1).alias("seq"), F.lit(None).cast("array<int>").alias("idx"), F.lit(P.dim).alias("dim"), F.lit(0).alias("bit_width"), F.lit("invalidate").alias("control"))
    return both.unionByName(stops)


_SEGMENTS = """rows AS (SELECT vec_id, label, (vec_id // 20) % 2 AS wide, sum(CAST(vec_id % 100 = 35 AS INTEGER)) OVER (PARTITION BY label ORDER BY vec_id) AS stops FROM embeddings),
turns AS (SELECT *, CAST(lag(wide) OVER w IS NULL OR lag(wide) OVER w <> wide OR lag(stops) OVER w <> stops AS INTEGER) AS new FROM rows WINDOW w AS (PARTITION BY label ORDER BY vec_id)),
segs AS (SELECT *, sum(new) OVER (PARTITION BY label ORDER BY vec_id) AS seg FROM turns),
nths AS (SELECT *, row_number() OVER (PARTITION BY label, seg ORDER BY vec_id) - 1 AS nth FROM segs)"""


@query(f"""WITH {_SEGMENTS},
e AS (SELECT *, nth % 7 AS tokens, nth % 7 = 0 AND NOT (label % 2 = 0 AND seg = 1 AND wide = 0 AND stops = 0 AND nth = 0) AS rebuilt FROM nths)
SELECT vec_id, tokens, rebuilt, CAST(sum(CAST(rebuilt AS INTEGER)) OVER (PARTITION BY label ORDER BY vec_id) + CASE WHEN label % 2 = 0 THEN 1 ELSE 0 END AS BIGINT) AS generation,
       min(vec_id) OVER (PARTITION BY label) AS policy FROM e""")
def reuse_policy_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generations of streams that change width, are invalidated, or begin with a book. ``policy``: the first vector of the policy's id."""
    tree = codecs.tree_literal(huffman.build_tree([0] * (1 << P.mse_bits)))
    books = embeddings(spark, sf_dir).where("label % 2 = 0").select(F.col("label").alias("stream_key")).distinct().withColumn("tree", tree)
    df = policy.encode_with_reuse(mixed_stream(spark, sf_dir), [P, WIDE], CADENCE, experimental_huffman=True, initial=books)
    return df.select("vec_id", "tokens", "rebuilt", F.col("codebook_generation").alias("generation"), F.min("vec_id").over(Window.partitionBy("policy_id")).alias("policy"))


_COST = "SELECT q.vec_id, CAST(ceil(sum(length(code)) / 8) AS BIGINT) AS b FROM q JOIN code ON code.vec_id = q.vec_id AND symbol = idx GROUP BY q.vec_id"
_PAYS = "CASE WHEN b >= {fixed} THEN 1 ELSE least(256, greatest(1, CAST(ceil({book} / ({fixed} - b)) AS BIGINT))) END"


@query(f"""WITH {_SEGMENTS},
cost AS (SELECT vec_id, 0 AS wide, {_PAYS.format(fixed=24, book=196)} AS cadence FROM ({T.sql(_COST, "code")}) UNION ALL SELECT vec_id, 1, {_PAYS.format(fixed=32, book=388)} FROM ({Twins(WIDE).sql(_COST, "code")})),
timed AS (SELECT n.*, first_value(cadence) OVER (PARTITION BY label, seg ORDER BY vec_id) AS cadence FROM nths n JOIN cost USING (vec_id, wide))
SELECT vec_id, CAST(cadence AS INTEGER) AS cadence, nth % cadence AS tokens, nth % cadence = 0 AS rebuilt, CAST(sum(CAST(nth % cadence = 0 AS INTEGER)) OVER (PARTITION BY label ORDER BY vec_id) AS BIGINT) AS generation,
       min(vec_id) OVER (PARTITION BY label, seg) AS policy FROM timed""")
def auto_policy_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The automatic policy on the same streams, without books to begin with: each run of a shape is a policy of its own."""
    df = policy.encode_auto(mixed_stream(spark, sf_dir), [P, WIDE], experimental_huffman=True)
    return df.select("vec_id", "cadence", "tokens", "rebuilt", F.col("codebook_generation").alias("generation"), F.min("vec_id").over(Window.partitionBy("policy_id")).alias("policy"))


# Sources and extensions


@query()
def synthetic_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synthetic_vectors(spark, 100, 8, seed=20260331)


@query(T.sql("SELECT * FROM (SELECT a.vec_id AS query_id, row_number() OVER (PARTITION BY a.vec_id ORDER BY sum(CAST(a.embedding[d.src + 1] AS DOUBLE) * d.sign * (d.c + sqrt(pi() / 2) * n.residual_norm / 64 * s.back)) DESC, d.vec_id) AS rank, d.vec_id FROM embeddings a, deq d JOIN norm n USING (vec_id) JOIN (SELECT vec_id, r, sum(p * sign) AS back FROM sgn JOIN proj USING (row) GROUP BY vec_id, r) s ON s.vec_id = d.vec_id AND s.r = d.coord WHERE a.vec_id % 50 = 0 GROUP BY a.vec_id, d.vec_id) WHERE rank <= 10", "sgn", "norm"))
def inner_product_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: the ten best reconstructed vectors for every query vector, those with a vec_id divisible by 50."""
    packets = vectors.quantize_prod(embeddings(spark, sf_dir).select("vec_id", "embedding"), P)
    queries = embeddings(spark, sf_dir).where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return vectors.inner_products(queries, packets, P).select("query_id", F.col("rank").cast("long").alias("rank"), "vec_id")
