import os
import shutil
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from quantaloom.functions import exprs, huffman, kernels
from quantaloom.functions.params import QuantParams, centroids
from quantaloom.operators import codecs, policy, vectors
from quantaloom.plans import fluent
from quantaloom.sources.vectors import read_packets, synthetic_vectors, write_packets


def rows_of(df, column, by="vec_id"):
    return np.array([r[column] for r in df.orderBy(by).collect()])


# Parameters


def test_params_depend_on_dim_width_and_seed_alone():
    a, b = QuantParams(32, 4, 55), QuantParams(32, 4, 55)
    assert (a.perm == b.perm).all() and (a.signs == b.signs).all() and (a.projection == b.projection).all()
    assert sorted(a.perm) == list(range(32)) and (a.perm[a.inverse] == np.arange(32)).all()
    assert (QuantParams(32, 4, 56).perm != a.perm).any()
    assert np.allclose(centroids(2, 64), [-0.18875, -0.056625, 0.056625, 0.18875])
    for bits in range(1, 9):
        c = centroids(bits, 64)
        assert len(c) == 1 << bits and (np.diff(c) > 0).all()


@pytest.mark.parametrize("bad", [dict(dim=0), dict(dim=4, bit_width=0), dict(dim=4, bit_width=10)])
def test_params_refuse(bad):
    with pytest.raises(ValueError):
        QuantParams(**bad)


def test_widths_one_and_two_both_index_with_one_bit():
    assert [QuantParams(8, b).mse_bits for b in (1, 2, 3, 9)] == [1, 1, 2, 8]


def test_residual_signs_need_no_rotation_back():
    p, g = QuantParams(16, 3, 5), np.random.default_rng(0)
    res = g.normal(size=(5, 16))
    rotated = res[:, p.perm] * p.signs
    assert np.allclose(res @ p.projection.T, rotated @ p.rotated_projection.T)


# Vectors


@pytest.mark.parametrize("case", range(12))
def test_engines_agree(spark, case):
    dim, bits = (16, 32, 64)[case % 3], (2, 3, 4, 5)[case // 3]
    p = QuantParams(dim, bits, 10_000 + case)
    df = synthetic_vectors(spark, 20, dim, 0xC0FFEE + case)
    a, b = vectors.fused(df, p, engine="arrow"), vectors.fused(df, p, engine="native")
    x = rows_of(df, "embedding")
    idx, value = kernels.quantize(x, p)
    for found in (a, b):
        assert (rows_of(found, "idx") == idx).all() and np.allclose(rows_of(found, "mse_rot"), value)
        assert (rows_of(found, "qjl") == kernels.qjl(kernels.residual(x, value, p), p.rotated_projection)).all()
    assert all(r["valid"] for r in vectors.validate_outputs(a, p).collect())


def test_validation_sees_a_changed_value(spark):
    p = QuantParams(16, 4, 1)
    df = vectors.fused(synthetic_vectors(spark, 4, 16, 1), p)
    wrong = df.withColumn("mse_rot", F.when(F.col("vec_id") == 2, F.transform("mse_rot", lambda v: v + 0.01)).otherwise(F.col("mse_rot")))
    assert [r["valid"] for r in vectors.validate_outputs(wrong, p).orderBy("vec_id").collect()] == [True, True, False, True]
    for dim in (16, 96):  # signs by expressions, and from the vector's own coordinates
        p_ = QuantParams(dim, 4, 1)
        turned = vectors.fused(synthetic_vectors(spark, 4, dim, 1), p_).withColumn("qjl", F.transform("qjl", lambda s, i: F.when((i == 9) & (F.col("vec_id") == 1), -s).otherwise(s)))
        assert [r["valid"] for r in vectors.validate_outputs(turned, p_).orderBy("vec_id").collect()] == [True, False, True, True]
    off = vectors.fused(synthetic_vectors(spark, 4, 16, 1), p, emit_qjl=False)
    assert all(r["qjl"] is None for r in off.collect()) and all(r["valid"] for r in vectors.validate_outputs(off, p).collect())


def unit(spark, rows, dim, seed):
    df = synthetic_vectors(spark, rows, dim, seed)
    g = np.random.default_rng(seed).normal(size=(rows, dim))
    g /= np.linalg.norm(g, axis=1)[:, None]
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(g)], df.schema), g.astype(np.float32).astype(float)


@pytest.mark.parametrize(("mse_bits", "distortion"), [(1, 0.361), (2, 0.117), (3, 0.0342), (4, 0.0097), (5, 0.0028)])
def test_distortion_and_unbiased_products(spark, mse_bits, distortion):
    p = QuantParams(64, mse_bits + 1, 9)
    df, x = unit(spark, 400, 64, 3)
    found = vectors.dequantize_prod(vectors.dequantize_mse(vectors.quantize_prod(df, p), p, "plain"), p)
    plain, full = rows_of(found, "plain"), rows_of(found, "xhat")
    assert ((x - plain) ** 2).sum(1).mean() == pytest.approx(distortion, rel=0.08)
    y = np.random.default_rng(8).normal(size=(200, 64))
    exact = (x @ y.T).ravel()
    slope = lambda z: exact @ (z @ y.T).ravel() / (exact @ exact)
    assert slope(full) == pytest.approx(1, abs=0.02) and slope(plain) < slope(full) + 0.005
    assert np.allclose(rows_of(found, "residual_norm"), np.linalg.norm(x - plain, axis=1))


def test_one_coordinate_is_that_of_the_whole(spark):
    p = QuantParams(16, 4, 2)
    df = vectors.dequantize_mse(vectors.quantize_mse(synthetic_vectors(spark, 5, 16, 2), p), p)
    for c in (0, 7, 15):
        assert np.allclose(rows_of(vectors.coordinate(df, p, c), "value"), rows_of(df, "xhat")[:, c])
    with pytest.raises(ValueError):
        vectors.coordinate(df, p, 16)


ODD = [(0, [0.1, 0.2, 0.3, 0.4]), (1, None), (2, [0.1]), (3, [float("nan"), 0.0, 0.0, 0.0]), (4, [float("inf"), 0.0, 0.0, 0.0]), (5, [0.0, 0.0, 0.0, -0.0])]


def test_strict_refuses_and_audit_reports(spark):
    df, p = spark.createDataFrame(ODD, "vec_id long, embedding array<float>"), QuantParams(4, 4, 11)
    audit = vectors.checked(df, 4, mode="audit")
    assert [r["vector_status"] for r in audit.orderBy("vec_id").collect()] == ["ok", "null", "dim", "non_finite", "non_finite", "ok"]
    assert [r["idx"] is None for r in vectors.fused(audit, p).orderBy("vec_id").collect()] == [False, True, True, True, True, False]
    for bad in range(1, 5):
        with pytest.raises(PySparkException):
            vectors.quantize_mse(vectors.checked(df.where(f"vec_id in (0, {bad})"), 4), p).select("idx").collect()


def test_what_is_not_finite_gets_index_zero(spark):
    p = QuantParams(4, 4, 11)
    x = np.array([[np.nan, np.inf, -np.inf, 0.3]])
    df = spark.createDataFrame([(0, x[0].tolist())], "vec_id long, embedding array<float>")
    idx = kernels.quantize(x, p)[0]
    assert (rows_of(vectors.quantize_mse(df, p), "idx") == idx).all() and (idx[0][~np.isfinite(x[0][p.perm])] == 0).all()
    assert (kernels.qjl(np.array([[np.nan] * 4]), p.rotated_projection) == -1).all()


def test_synthetic_rows_do_not_depend_on_partitions(spark):
    a, b = (rows_of(synthetic_vectors(spark, 40, 6, 5, partitions=n), "embedding") for n in (1, 7))
    assert (a == b).all() and (np.abs(a) <= 1).all()


# Codecs


def test_goldens():
    assert kernels.pack(np.array([[5 * c % 8 for c in range(64)]]), 3).tolist() == [[2826489512, 3467147470, 2026809464, 2826489512, 3467147470, 2026809464]]
    table, crc = exprs.crc32c_table(), 0xFFFFFFFF
    for b in b"123456789":
        crc = table[(crc ^ b) & 255] ^ (crc >> 8)
    assert crc ^ 0xFFFFFFFF == 0xE3069283


def test_delta_xor_of_three_words(spark):
    df = spark.createDataFrame([([5, 3, 7],)], "w array<long>").select(exprs.delta_xor(F.col("w")).alias("x")).withColumn("back", exprs.undo_delta_xor(F.col("x")))
    assert tuple(df.first()) == ([5, 6, 4], [5, 3, 7])


@pytest.mark.parametrize(("dim", "bits"), [(1, 3), (2, 3), (8, 4), (33, 6), (64, 2), (96, 9), (700, 4)])
def test_round_trips(spark, dim, bits):
    p = QuantParams(dim, bits, 0xFACE)
    df = vectors.quantize_mse(synthetic_vectors(spark, 6, dim, dim), p, engine="arrow").select("vec_id", "idx")
    idx = rows_of(df, "idx")
    packets = codecs.bitpack(df, p, "arrow")
    if dim <= 64:
        assert rows_of(codecs.bitpack(df, p), "payload_words").tolist() == rows_of(packets, "payload_words").tolist()
        assert (rows_of(codecs.bitpack(df, p), "payload_crc32c") == rows_of(packets, "payload_crc32c")).all()
    if dim <= 8:
        assert (rows_of(codecs.decode(packets, p, engine="native"), "idx") == idx).all()
    for found in (packets, codecs.delta_xor(packets), codecs.huffman_encode(df, p, experimental_huffman=True), codecs.huffman_encode(df, p, huffman.build_tree([1] * (1 << p.mse_bits)), True, embed=True)):
        assert (rows_of(codecs.decode(found, p, experimental_huffman=True), "idx") == idx).all()


def brute_tree(counts):
    """Joins by scanning all open nodes each time."""
    n = len(counts)
    weight, open_, links = {i: c + 1 for i, c in enumerate(counts)}, set(range(n)), {}
    for node in range(n, 2 * n - 1):
        a, b = sorted(open_, key=lambda i: (weight[i], i))[:2]
        weight[node], links[node] = weight[a] + weight[b], (a, b)
        open_ = (open_ - {a, b}) | {node}
    return links


def test_trees_against_brute_force():
    g = np.random.default_rng(3)
    for _ in range(50):
        counts = g.integers(0, 6, 1 << g.integers(1, 6)).tolist()
        tree = huffman.build_tree(counts)
        assert {n: (tree.left[n], tree.right[n]) for n in range(len(counts), 2 * len(counts) - 1)} == brute_tree(counts)
        assert tree.root == 2 * len(counts) - 2 and tree.parent[tree.root] == huffman.NONE
        assert sum(2.0 ** -len(c) for c in huffman.codes(tree)) == 1


def test_no_symbols_count_as_one_zero():
    assert huffman.symbol_counts(np.array([], int), 4).tolist() == [1, 0, 0, 0] and huffman.symbol_counts(np.array([9, 1]), 4).tolist() == [0, 1, 0, 0]


def test_huffman_is_gated(spark):
    p = QuantParams(8, 4, 1)
    df = vectors.quantize_mse(synthetic_vectors(spark, 2, 8, 1), p).select("vec_id", "idx")
    for call in (lambda: codecs.huffman_encode(df, p), lambda: codecs.build_codebook(df, p), lambda: policy.encode_with_reuse(df, p, 2), lambda: policy.encode_auto(df, p)):
        with pytest.raises(codecs.HuffmanDisabled):
            call()
    packets = codecs.huffman_encode(df, p, experimental_huffman=True)
    assert {r["status"] for r in codecs.decode(packets, p, mode="audit").collect()} == {"huffman_disabled"}
    with pytest.raises(ValueError):
        codecs.huffman_encode(df, p, huffman.build_tree([1, 1]), True)


@pytest.fixture(scope="module")
def packets(spark):
    p = QuantParams(64, 4, 0xFACE)
    return p, codecs.bitpack(vectors.quantize_mse(synthetic_vectors(spark, 3, 64, 1), p).select("vec_id", "idx"), p).cache()


@pytest.mark.parametrize(
    ("column", "value", "status"),
    [
        ("dim", "0", "dim"), ("bit_width", "0", "bit_width"), ("word_count", "0", "word_count"), ("word_count", "5", "word_count"), ("valid_bits", "1000", "capacity"), ("valid_bits", "100", "word_bits_mismatch"),
        ("valid_bits", "191", "fixed_bits_mismatch"), ("payload_crc32c", "null", "crc_missing"), ("payload_crc32c", "1", "crc_mismatch"), ("payload_words", "transform(payload_words, (w, i) -> if(i = 0, w ^ 1, w))", "crc_mismatch"),
        ("payload_words", "null", "word_count"), ("dim", "null", "dim"), ("encoding", "null", "undecodable"), ("seed", "5", "ok"),
    ],
)
def test_packets_that_break_a_check(packets, column, value, status):
    p, good = packets
    bad = good.withColumn(column, F.expr(value).cast(good.schema[column].dataType))
    assert {r["status"] for r in codecs.decode(bad, p, mode="audit", experimental_huffman=True).collect()} == {status}
    if status != "ok":
        with pytest.raises(PySparkException):
            codecs.decode(bad, p, experimental_huffman=True).select("idx").collect()


def test_packets_of_other_parameters_are_refused(packets):
    _, good = packets
    assert {r["status"] for r in codecs.decode(good, QuantParams(48, 5, 1), mode="audit").collect()} == {"params_mismatch"}
    with pytest.raises(PySparkException):
        codecs.delta_xor(codecs.delta_xor(good)).collect()


def test_missing_written_bits_fall_back(spark):
    p = QuantParams(128, 4, 0xC0C0)
    df = vectors.quantize_mse(synthetic_vectors(spark, 2, 128, 4), p).select("vec_id", "idx")
    found = codecs.huffman_encode(df, p, experimental_huffman=True).withColumn("written_bits", F.lit(None).cast("long"))
    found = codecs._ordered(codecs._stamped(found, "arrow"))
    assert (rows_of(codecs.decode(found, p, experimental_huffman=True), "idx") == rows_of(df, "idx")).all()
    assert {r["wire_bytes"] for r in codecs.accounting(found).collect()} == {128 * 8 // 8}


def test_bits_that_end_early_are_undecodable(spark):
    p = QuantParams(32, 4, 3)
    df = vectors.quantize_mse(synthetic_vectors(spark, 2, 32, 4), p).select("vec_id", "idx")
    short = codecs.huffman_encode(df, p, experimental_huffman=True).withColumn("written_bits", F.lit(5).cast("long"))
    short = codecs._ordered(codecs._stamped(short, "arrow"))
    assert {r["status"] for r in codecs.decode(short, p, mode="audit", experimental_huffman=True).collect()} == {"undecodable"}


def test_packets_survive_parquet(packets, spark, tmp_path):
    p, good = packets
    write_packets(good, str(tmp_path / "p"))
    assert rows_of(codecs.decode(read_packets(spark, str(tmp_path / "p")), p), "idx").tolist() == rows_of(codecs.decode(good, p), "idx").tolist()


# Policies


def stream_of(spark, p, rows, streams=2, seed=1):
    df = vectors.quantize_mse(synthetic_vectors(spark, rows, p.dim, seed), p)
    return df.select("vec_id", (F.col("vec_id") % streams).alias("stream_key"), F.col("vec_id").alias("seq"), "idx")


def simulated(rows, levels, cadence):
    """(generation, rebuilt, bits) of each vector, one after the other."""
    out, book, tokens, generation = [], None, 0, 0
    for idx in rows:
        rebuilt = book is None or tokens >= cadence
        if rebuilt:
            book, tokens, generation = huffman.build_tree(huffman.symbol_counts(np.array(idx), levels)), 0, generation + 1
        size = [len(c) for c in huffman.codes(book)]
        out.append((generation, rebuilt, sum(size[k] for k in idx)))
        tokens += 1
    return out


@pytest.mark.parametrize("cadence", [1, 2, 5, 100])
def test_reuse_is_the_policy_step_by_step(spark, cadence):
    p = QuantParams(64, 4, 0xDA7C)
    df = stream_of(spark, p, 24)
    found = policy.encode_with_reuse(df, p, cadence, experimental_huffman=True).orderBy("seq").collect()
    for key in (0, 1):
        own = [r for r in df.orderBy("seq").collect() if r["stream_key"] == key]
        got = [(r["codebook_generation"], r["rebuilt"], r["written_bits"]) for r in found if r["stream_key"] == key]
        assert got == simulated([r["idx"] for r in own], 8, cadence)
    books = policy.registry(df, p, cadence)
    back = policy.decode_with_policy(policy.encode_with_reuse(df, p, cadence, experimental_huffman=True), books, p)
    assert (rows_of(back, "idx") == rows_of(df, "idx")).all()


def test_a_change_of_width_rebuilds(spark):
    rows = [(0, i, w) for i, w in enumerate([3, 3, 3, 4, 4, 3, 3, 3])]
    found = policy.reuse_epochs(spark.createDataFrame(rows, "stream_key long, seq long, bit_width int"), 2).orderBy("seq").collect()
    assert [r["rebuilt"] for r in found] == [True, False, True, True, False, True, False, True] and [r["generation"] for r in found] == [1, 1, 2, 3, 3, 4, 4, 5]


class Reuse:
    """The fixed policy, a call a vector."""

    def __init__(self, cadence, tree=None):
        self.cadence, self.book, self.tokens, self.generation = cadence, tree, 0, int(tree is not None)

    def invalidate(self):
        self.book, self.tokens = None, 0

    def encode(self, idx, bits):
        rebuilt = self.book is None or self.book.levels != 1 << bits or self.tokens >= self.cadence
        if rebuilt:
            self.book, self.tokens, self.generation = huffman.build_tree(huffman.symbol_counts(np.array(idx), 1 << bits)), 0, self.generation + 1
        self.tokens += 1
        size = [len(c) for c in huffman.codes(self.book)]
        return self.tokens - 1, rebuilt, self.generation, sum(size[k] for k in idx)


class Auto:
    """The automatic policy, a call a vector."""

    def __init__(self):
        self.inner, self.shape, self.number = None, None, 0

    def invalidate(self):
        self.inner, self.shape = (self.inner[0], None), None

    def encode(self, idx, bits):
        if self.shape != (len(idx), bits):
            tree = huffman.build_tree(huffman.symbol_counts(np.array(idx), 1 << bits))
            size = [len(c) for c in huffman.codes(tree)]
            saved = max(0, -(-len(idx) * bits // 8) - -(-sum(size[k] for k in idx) // 8))
            cadence = 1 if not saved else max(1, min(256, -(-((6 << bits) + 1) * 4 // saved)))
            generation = self.inner[0] if self.inner else 0
            self.inner, self.shape, self.number = (generation, Reuse(cadence)), (len(idx), bits), self.number + 1
        before, policy_ = self.inner
        tokens, rebuilt, generation, written = policy_.encode(idx, bits)
        if rebuilt:
            self.inner = (before + 1, policy_)
        return tokens, rebuilt, self.inner[0], written, policy_.cadence, self.number


def shaped_stream(spark, seed=4):
    """Three streams whose vectors change dim and width, with control rows between; and the rows as a list."""
    g, rows = np.random.default_rng(seed), []
    for key in range(3):
        dim, bits = 32, 3
        for seq in range(60):
            if g.random() < 0.12:
                dim, bits = int(g.choice([32, 64])), int(g.choice([2, 3]))
            drop = g.random() < 0.08
            skewed = np.minimum(g.geometric(0.6, dim) - 1, (1 << bits) - 1)
            rows.append((key, seq, None if drop else [int(v) for v in skewed], dim, bits, "invalidate" if drop else None))
    return spark.createDataFrame(rows, "stream_key long, seq long, idx array<int>, dim int, bit_width int, control string").repartition(5), rows


SHAPES = [QuantParams(32, 3, 1), QuantParams(32, 4, 1), QuantParams(64, 3, 1), QuantParams(64, 4, 1)]


def played(rows, make):
    want = {}
    for key in range(3):
        one = make(key)
        for _, seq, idx, _, bits, control in (r for r in rows if r[0] == key):
            if control:
                one.invalidate()
            else:
                want[key, seq] = one.encode(idx, bits)
    return want


@pytest.mark.parametrize("cadence", [1, 4])
def test_streams_that_change_shape(spark, cadence):
    df, rows = shaped_stream(spark)
    tree = huffman.build_tree([5, 1, 1, 1, 0, 0, 0, 2])
    books = spark.range(2).select(F.col("id").alias("stream_key"), codecs.tree_literal(tree).alias("tree"))
    want = played(rows, lambda key: Reuse(cadence, tree if key < 2 else None))
    made = policy.encode_with_reuse(df, SHAPES, cadence, experimental_huffman=True, initial=books)
    assert {(r["stream_key"], r["seq"]): (r["tokens"], r["rebuilt"], r["codebook_generation"], r["written_bits"]) for r in made.collect()} == want
    assert made.select("policy_id").distinct().count() == 3
    registry = policy.registry(df, SHAPES, cadence, initial=books)
    assert registry.groupBy("policy_id", "generation").count().where("count > 1").isEmpty()
    for p in SHAPES:
        back = policy.decode_with_policy(made.where((F.col("dim") == p.dim) & (F.col("bit_width") == p.mse_bits)), registry, p).collect()
        assert all(r["idx"] == next(x[2] for x in rows if x[:2] == (r["stream_key"], r["seq"])) for r in back)


def test_the_automatic_policy_on_streams_that_change_shape(spark):
    df, rows = shaped_stream(spark, 6)
    want = played(rows, lambda key: Auto())
    made = policy.encode_auto(df, SHAPES, experimental_huffman=True).collect()
    assert {(r["stream_key"], r["seq"]): (r["tokens"], r["rebuilt"], r["codebook_generation"], r["written_bits"], r["cadence"]) for r in made} == {k: v[:5] for k, v in want.items()}
    ids = {(r["stream_key"], want[r["stream_key"], r["seq"]][5]): set() for r in made}
    for r in made:
        ids[r["stream_key"], want[r["stream_key"], r["seq"]][5]].add(r["policy_id"])
    assert all(len(x) == 1 for x in ids.values()) and len(set.union(*ids.values())) == len(ids) > 10
    status = policy.policy_status(policy.encode_auto(df, SHAPES, experimental_huffman=True), policy.registry_auto(df, SHAPES))
    assert {r["status"] for r in status.collect()} == {"ok"}


def test_rows_of_no_given_shape_end_the_query(spark):
    df, _ = shaped_stream(spark)
    with pytest.raises(PySparkException):
        policy.encode_with_reuse(df, SHAPES[:2], 3, experimental_huffman=True).collect()


def test_policies_refuse(spark):
    p = QuantParams(32, 4, 0xE100)
    df = stream_of(spark, p, 8)
    made, books = policy.encode_with_reuse(df, p, 2, experimental_huffman=True), policy.registry(df, p, 2)
    status = lambda packets, books=books, **k: {r["status"] for r in policy.policy_status(packets, books, **k).collect()}
    assert status(made) == {"ok"}
    assert status(made.withColumn("policy_id", F.lit(5).cast("long"))) == {"policy_id"} and status(made, books.limit(0)) == {"policy_id"}
    assert status(made.withColumn("codebook_generation", F.lit(99).cast("long"))) == {"generation"}
    assert status(made.withColumn("codebook_fingerprint", F.lit("x"))) == {"fingerprint"} == status(made.withColumn("codebook_fingerprint", F.lit(None).cast("string")))
    newest = books.groupBy("policy_id").agg(F.max("generation").alias("generation"))
    assert status(made, active=newest) == {"ok", "generation"}
    fixed = codecs.bitpack(df, p)
    assert status(fixed) == {"ok"}  # packets of fixed width skip the policy
    with pytest.raises(ValueError):
        policy.reuse_epochs(df, 0)


@pytest.mark.parametrize("bits", [2, 3, 4, 5])
def test_auto_cadence_is_bounded(spark, bits):
    p = QuantParams(96, bits, 0xE001)
    for r in policy.auto_cadence(stream_of(spark, p, 6), p).collect():
        tree = huffman.build_tree(huffman.symbol_counts(np.array(r["idx"]), 1 << p.mse_bits))
        size = [len(c) for c in huffman.codes(tree)]
        saved = max(0, -(-96 * p.mse_bits // 8) - -(-sum(size[k] for k in r["idx"]) // 8))
        want = 1 if saved == 0 else max(1, min(256, -(-((6 << p.mse_bits) + 1) * 4 // saved)))
        assert r["cadence"] == want and 1 <= want <= 256


def test_auto_round_trip_and_single_symbol(spark):
    p = QuantParams(128, 4, 0xA11CE)
    df = spark.createDataFrame([(i, [0.125] * 128) for i in range(5)], "vec_id long, embedding array<float>")
    df = vectors.quantize_mse(df, p).select("vec_id", F.lit(0).cast("long").alias("stream_key"), F.col("vec_id").alias("seq"), "idx")
    found = policy.encode_auto(df, p, experimental_huffman=True)
    first = found.orderBy("seq").first()
    assert first["cadence"] > 1 and first["written_bits"] < 128 * 3
    assert found.agg(F.max("codebook_generation")).first()[0] == -(-5 // first["cadence"])


def test_the_stream_is_the_batch(spark, tmp_path):
    from quantaloom.streaming.policy import reuse_stream

    p = QuantParams(16, 4, 5)
    df = stream_of(spark, p, 30, 3)
    for i in range(3):
        df.where(f"seq >= {10 * i} and seq < {10 * i + 10}").coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    q = reuse_stream(source, p, 4, True).writeStream.format("memory").queryName("reused").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r["stream_key"], r["seq"]): (r["generation"], r["rebuilt"], r["written_bits"]) for r in spark.table("reused").collect()}
    want = policy.encode_with_reuse(df, p, 4, experimental_huffman=True).collect()
    assert got == {(r["stream_key"], r["seq"]): (r["codebook_generation"], r["rebuilt"], r["written_bits"]) for r in want} and len(got) == 30


# Builder and registry


def test_builder(spark):
    df = synthetic_vectors(spark, 6, 48, 77)
    codec = fluent.vector_codec(df).bit_width(4).seed(77).experimental_huffman()
    p = codec.params()
    assert p == QuantParams(48, 4, 77)
    idx = rows_of(codec.quantize(), "idx")
    for entropy in (True, False):
        for qjl in (True, False):
            for engine in vectors.ENGINES:
                packets = codec.emit_entropy(entropy).emit_qjl(qjl).engine(engine).pipeline()
                assert {r["encoding"] for r in packets.collect()} == {"delta_xor" if entropy else "bitpacked"}
                assert (rows_of(codec.decode(packets), "idx") == idx).all()
    indexed = codec.quantize().select("vec_id", "idx")
    assert (rows_of(codec.decode(codec.huffman(indexed)), "idx") == idx).all()
    assert all(r["valid"] for r in codec.validate().collect())
    assert np.allclose(rows_of(codec.mse(rotated=True), "mse")[:, p.inverse] * p.signs[p.inverse], rows_of(codec.mse(), "mse"))
    assert set(np.unique(rows_of(codec.prod(), "qjl"))) == {-1, 1} and rows_of(codec.reconstruct(), "xhat").shape == (6, 48)
    with pytest.raises(ValueError):
        codec.bit_width(0)
    with pytest.raises(ValueError):
        fluent.vector_codec(df.limit(0)).params()


def test_sql_functions(spark):
    p = QuantParams(16, 4, 3)
    fluent.register_functions(spark, p)
    synthetic_vectors(spark, 5, 16, 1).createOrReplaceTempView("some_vectors")
    got = spark.sql("SELECT vq_unpack(vq_pack(vq_quantize(embedding))) = vq_quantize(embedding) AS same, size(vq_signs(embedding)) AS n, vq_dequantize(vq_quantize(embedding)) AS x, vq_crc32c(vq_pack(vq_quantize(embedding))) AS c FROM some_vectors").collect()
    assert all(r["same"] and r["n"] == 16 and len(r["x"]) == 16 for r in got)


def test_top_k(spark):
    p = QuantParams(16, 6, 3)
    df, x = unit(spark, 60, 16, 5)
    packets = vectors.quantize_prod(df, p)
    approx = rows_of(vectors.dequantize_prod(packets, p), "xhat")
    queries = df.where("vec_id < 3").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    got = {}
    for r in vectors.inner_products(queries, packets.repartition(5), p, 4).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert got == {q: np.argsort(-(approx @ x[q]), kind="stable")[:4].tolist() for q in range(3)}


def test_blocks_of_queries_find_the_same(spark, monkeypatch):
    p = QuantParams(16, 6, 3)
    df, _ = unit(spark, 60, 16, 5)
    packets = vectors.quantize_prod(df, p)
    queries = df.where("vec_id < 7").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    whole = sorted(map(tuple, vectors.inner_products(queries, packets, p, 4).collect()))
    monkeypatch.setattr(vectors, "QUERIES_AT_ONCE", 3)
    assert sorted(map(tuple, vectors.inner_products(queries, packets, p, 4).collect())) == whole and len(whole) == 28
    assert vectors.inner_products(queries.limit(0), packets, p, 4).count() == 0


def test_equal_scores_are_ranked_by_id_whatever_the_batches(spark):
    p = QuantParams(16, 6, 3)
    _, x = unit(spark, 1, 16, 5)
    df = spark.createDataFrame([(100 - i, [float(v) for v in x[0]]) for i in range(30)], "vec_id long, embedding array<float>").coalesce(1)
    queries = df.where("vec_id = 100").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    found = vectors.inner_products(queries, vectors.quantize_prod(df, p), p, 3).orderBy("rank").collect()
    assert [r["vec_id"] for r in found] == [71, 72, 73]


def test_more_queries_than_a_block(spark):
    p = QuantParams(16, 6, 3)
    df, _ = unit(spark, 20, 16, 5)
    queries = spark.range(10_001).selectExpr("id AS query_id").crossJoin(df.where("vec_id = 0").select(F.col("embedding").alias("query")))
    assert vectors.inner_products(queries, vectors.quantize_prod(df, p), p, 1).count() == 10_001


def test_registry_names():
    import __spark_entry__ as entry

    names = entry.queries()
    assert len(names) >= 45 and set(entry.oracle_sql()) <= set(names)


def test_the_registry_without_the_subpackage_of_operators(tmp_path):
    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root / "quantaloom", tmp_path / "quantaloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    if (root / "corpus_pipeline.py").exists():
        shutil.copy(root / "corpus_pipeline.py", tmp_path)
    check = "import __spark_entry__ as e; q = e.queries(); assert len(q) >= 45 and set(e.oracle_sql()) <= set(q) and 'pipeline' not in q"
    subprocess.run([sys.executable, "-c", check], cwd=tmp_path, check=True, timeout=120, env={**os.environ, "PYTHONPATH": str(tmp_path)})


def test_invalidation_keeps_the_generation(spark, tmp_path):
    from quantaloom.streaming.policy import reuse_stream

    p = QuantParams(16, 4, 5)
    df = stream_of(spark, p, 6, 1).withColumn("control", F.when(F.col("seq") == 3, "invalidate"))
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    q = reuse_stream(source, p, 100, True).writeStream.format("memory").queryName("dropped").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r["seq"]: (r["generation"], r["tokens"]) for r in spark.table("dropped").collect()}
    assert got == {0: (1, 0), 1: (1, 1), 2: (1, 2), 4: (2, 0), 5: (2, 1)}


def test_the_stream_changes_width_and_begins_with_a_book(spark, tmp_path):
    from quantaloom.streaming.policy import reuse_stream

    df, rows = shaped_stream(spark)
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    tree = huffman.build_tree([5, 1, 1, 1, 0, 0, 0, 2])
    source = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    q = reuse_stream(source, SHAPES[0], 4, True, tree).writeStream.format("memory").queryName("shaped").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r["stream_key"], r["seq"]): (r["tokens"], r["rebuilt"], r["generation"], r["written_bits"]) for r in spark.table("shaped").collect()}
    assert got == played(rows, lambda key: Reuse(4, tree))


def test_pages_are_taken_once(spark, tmp_path):
    from quantaloom.streaming.policy import paged

    rows = [(1, 0, 7, v, f"2026-01-01 00:00:0{i}") for i, v in enumerate([1, 1, 2, 2, 1])]
    df = spark.createDataFrame(rows, "sequence_id long, layer_id long, page_id long, page_version long, ts string").withColumn("ts", F.to_timestamp("ts"))
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    q = paged(source).writeStream.format("memory").queryName("pages").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r["page_version"] for r in spark.table("pages").collect()) == [1, 2]
