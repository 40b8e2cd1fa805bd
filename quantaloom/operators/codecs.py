"""Index codecs and packets. A packet is a row: its payload words, what they mean, and a checksum.

Packet columns: encoding (bitpacked, delta_xor, huffman), dim, bit_width (of the indices), seed, word_count, valid_bits,
written_bits (Huffman: the bits in use of valid_bits), payload_words (0 to 2^32 - 1), payload_crc32c, policy_id,
codebook_generation, codebook_fingerprint, and tree (a Huffman tree that travels with its packet; else null).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantaloom.functions import exprs, huffman, kernels
from quantaloom.functions.params import QuantParams
from quantaloom.operators import vectors
from quantaloom.sources.session import ship

ENCODINGS = ("bitpacked", "delta_xor", "huffman")
TREE = "struct<parent: array<bigint>, left: array<bigint>, right: array<bigint>, root: int>"
PACKET_COLUMNS = ("encoding", "dim", "bit_width", "seed", "word_count", "valid_bits", "written_bits", "payload_words", "payload_crc32c", "policy_id", "codebook_generation", "codebook_fingerprint", "tree")


class HuffmanDisabled(ValueError):
    """Huffman coding was asked for without being switched on."""


def require_huffman(enabled: bool) -> None:
    if not enabled:
        raise HuffmanDisabled("Huffman coding is experimental: switch it on with experimental_huffman=True")


def once(f):
    """The function, kept where it stands in a plan: a chain of them is neither folded together nor run twice."""
    return f.asNondeterministic()


def _stamped(df: DataFrame, engine: str = "native") -> DataFrame:
    """Counts the words and sets the checksum, over written bits where known."""
    df = df.withColumn("word_count", F.size("payload_words"))
    crc = exprs.packet_crc() if engine == "native" else _crc_udf(df)(F.col("payload_words"), F.coalesce("written_bits", "valid_bits"))
    return df.withColumn("payload_crc32c", crc)


def _ordered(df: DataFrame) -> DataFrame:
    return df.select(*(c for c in df.columns if c not in PACKET_COLUMNS), *PACKET_COLUMNS)


def _blank(df: DataFrame, encoding: str, p: QuantParams) -> DataFrame:
    none = {"written_bits": "long", "policy_id": "long", "codebook_generation": "long", "codebook_fingerprint": "string", "tree": TREE}
    return df.withColumns(
        {"encoding": F.lit(encoding), "dim": F.lit(p.dim), "bit_width": F.lit(p.mse_bits), "seed": F.lit(p.seed).cast("long"), "valid_bits": F.lit(p.dim * p.mse_bits).cast("long")}
        | {name: F.lit(None).cast(kind) for name, kind in none.items()}
    )


def _crc_udf(df: DataFrame):
    ship(df.sparkSession)

    @F.arrow_udf("bigint")
    def run(words: pa.Array, bits: pa.Array) -> pa.Array:
        size = np.diff(np.asarray(words.offsets))
        out = np.zeros(len(words), np.int64)
        given = ~np.asarray(words.is_null())
        counts = bits.fill_null(0).to_numpy(zero_copy_only=False)
        for n in np.unique(size[given]):  # packets of one length at a time
            own = np.flatnonzero(given & (size == n))
            rows, _ = kernels.matrix(words.take(pa.array(own)), int(n), "int64")
            out[own] = kernels.crc32c(rows, counts[own])
        return pa.array(out, mask=~given)

    return once(run)


def bitpack(df: DataFrame, p: QuantParams, engine: str = "native") -> DataFrame:
    """``idx`` to bitpacked packets."""
    if engine == "native":
        words = exprs.bitpack(F.col("idx"), p.dim, p.mse_bits)
    else:
        ship(df.sparkSession)

        @F.arrow_udf("array<bigint>")
        def run(idx: pa.Array) -> pa.Array:
            k, given = kernels.matrix(idx, p.dim, "int64")
            return kernels.lists(kernels.pack(k, p.mse_bits), given, pa.int64())

        words = once(run)(F.col("idx"))
    packed = df.withColumn("payload_words", F.when(F.col("idx").isNotNull(), words) if engine == "native" else words).drop("idx")
    return _ordered(_stamped(_blank(packed, "bitpacked", p), engine))


def delta_xor(packets: DataFrame, engine: str = "arrow") -> DataFrame:
    """Each word xored with the one before it. Only bitpacked packets are taken: another would decode to other indices."""
    wrong = F.raise_error(F.concat(F.lit("delta_xor takes bitpacked packets, not "), F.coalesce("encoding", F.lit("null")))).cast("array<bigint>")
    packets = packets.withColumn("_x", exprs.delta_xor(F.col("payload_words")) if engine == "native" else _xor_udf(packets)(F.col("payload_words")))
    words = F.when(F.col("encoding") == "bitpacked", F.col("_x")).otherwise(wrong)
    return _ordered(_stamped(packets.withColumns({"payload_words": words, "encoding": F.lit("delta_xor")}).drop("_x"), engine))


def _xor_udf(df: DataFrame):
    ship(df.sparkSession)

    @F.arrow_udf("array<bigint>")
    def run(words: pa.Array) -> pa.Array:
        size = np.diff(np.asarray(words.offsets))
        given = ~np.asarray(words.is_null())
        flat = np.asarray(words.flatten())
        before = np.r_[0, flat[:-1]] if len(flat) else flat
        before[np.r_[0, np.cumsum(size)[:-1]][size > 0] if len(size) else []] = 0
        ends = pa.array(np.r_[0, np.cumsum(size)].astype(np.int32))
        return pa.ListArray.from_arrays(ends, pa.array(flat ^ before, pa.int64()), mask=None if given.all() else pa.array(~given))

    return once(run)


def _tree_row(tree: huffman.Tree) -> dict:
    return {"parent": list(tree.parent), "left": list(tree.left), "right": list(tree.right), "root": tree.root}


def build_codebook(df: DataFrame, p: QuantParams, experimental_huffman: bool = False) -> DataFrame:
    """Adds ``tree``: the Huffman tree of each row's own symbol counts."""
    require_huffman(experimental_huffman)
    fit = F.when((F.size("idx") == p.dim) | F.col("idx").isNull(), F.col("idx")).otherwise(F.raise_error(F.lit(f"rows of {p.dim} indices are expected")).cast("array<int>"))
    return df.withColumn("tree", trees(df, fit, F.lit(p.mse_bits)))


def histograms(idx: pa.Array, levels: np.ndarray) -> np.ndarray:
    """How often each symbol below its row's number of levels occurs in it; without any, symbol 0 counts once."""
    most = int(levels.max(initial=1))
    row = np.repeat(np.arange(len(idx)), np.diff(np.asarray(idx.offsets)))
    symbol = np.asarray(idx.flatten()).astype(np.int64)
    fit = symbol < levels[row]
    counts = np.bincount(row[fit] * most + symbol[fit], minlength=len(idx) * most).reshape(len(idx), most)
    counts[:, 0] += counts.sum(1) == 0
    return counts


def _by_histogram(idx: pa.Array, bits: pa.Array):
    """(tree, counts, its rows): one tree for all rows of equal counts; null rows have none."""
    idx = idx.combine_chunks() if isinstance(idx, pa.ChunkedArray) else idx
    levels = 1 << bits.fill_null(1).to_numpy(zero_copy_only=False).astype(np.int64)
    given = np.flatnonzero(~np.asarray(idx.is_null()))
    if not len(given):
        return
    counts = histograms(idx.take(pa.array(given)), levels[given])
    keyed, of = np.unique(np.c_[levels[given], counts], axis=0, return_inverse=True)
    order = np.argsort(of.ravel(), kind="stable")
    for key, rows in zip(keyed, np.split(given[order], np.flatnonzero(np.diff(of.ravel()[order])) + 1), strict=True):
        own = key[1 : 1 + key[0]]
        yield huffman.build_tree(own), own, rows


def trees(df: DataFrame, idx: Column, bits: Column) -> Column:
    """The tree of each row's own counts, for rows of any length and width; null where ``idx`` is."""
    ship(df.sparkSession)

    @F.arrow_udf(TREE)
    def run(idx: pa.Array, bits: pa.Array) -> pa.Array:
        made, which = [], np.full(len(idx), -1)
        for n, (tree, _, rows) in enumerate(_by_histogram(idx, bits)):
            made.append(_tree_row(tree))
            which[rows] = n
        return pa.array(made, _tree_type()).take(pa.array(which, mask=which < 0))

    return once(run)(idx, bits)


def coded_bits(df: DataFrame, idx: Column, bits: Column) -> Column:
    """The bits that each row takes with the tree of its own counts; null where ``idx`` is."""
    ship(df.sparkSession)

    @F.arrow_udf("bigint")
    def run(idx: pa.Array, bits: pa.Array) -> pa.Array:
        out = np.full(len(idx), -1, np.int64)
        idx = idx.combine_chunks() if isinstance(idx, pa.ChunkedArray) else idx
        size = np.diff(np.asarray(idx.offsets))
        for tree, counts, rows in _by_histogram(idx, bits):
            lengths = np.array([len(c) for c in huffman.codes(tree)])
            out[rows] = np.where(size[rows] > 0, int((counts * lengths).sum()), 0)
        return pa.array(out, mask=out < 0)

    return once(run)(idx, bits)


def _tree_type() -> pa.DataType:
    links = pa.list_(pa.int64())
    return pa.struct([("parent", links), ("left", links), ("right", links), ("root", pa.int32())])


def tree_literal(tree: huffman.Tree) -> Column:
    links = ((name, exprs.longs(getattr(tree, name)).alias(name)) for name in ("parent", "left", "right"))
    return F.struct(*(column for _, column in links), F.lit(tree.root).alias("root")).cast(TREE)


def tree_of(row: dict) -> huffman.Tree:
    return huffman.Tree(tuple(row["parent"]), tuple(row["left"]), tuple(row["right"]), row["root"])


def symbol_histogram(df: DataFrame, p: QuantParams, by: list[str]) -> DataFrame:
    """(by, symbol, n) with a row for each symbol, also those that do not occur. Counted in part before the shuffle."""
    levels = 1 << p.mse_bits
    counts = df.select(*by, F.explode_outer("idx").alias("symbol")).where(F.col("symbol") < levels).groupBy(*by, "symbol").agg(F.count(F.lit(1)).alias("n"))
    all_ = df.select(*by).distinct().select(*by, F.explode(F.sequence(F.lit(0), F.lit(levels - 1))).alias("symbol"))
    return all_.join(counts, [*by, "symbol"], "left").select(*by, "symbol", F.coalesce("n", F.lit(0)).alias("n"))


def huffman_encode(df: DataFrame, p: QuantParams, tree: str | huffman.Tree | None = None, experimental_huffman: bool = False, embed: bool | None = None) -> DataFrame:
    """``idx`` to Huffman packets.

    ``tree``: None builds one for each row and embeds it; a Tree is shared by all; a name is the column that has it.
    Capacity (valid_bits) is ``levels`` bits a symbol; written_bits are in use.
    """
    require_huffman(experimental_huffman)
    ship(df.sparkSession)
    levels = 1 << p.mse_bits
    if tree is None:
        df, tree = build_codebook(df, p, True), "tree"
        embed = True if embed is None else embed
    if isinstance(tree, huffman.Tree) and tree.levels != levels:
        raise ValueError("the codebook is of another width than the indices")
    shared = tree if isinstance(tree, huffman.Tree) else None

    @F.arrow_udf("struct<words: array<bigint>, written: bigint>")
    def run(idx: pa.Array, trees: pa.Array) -> pa.Array:
        k, given = kernels.matrix(idx, p.dim, "int64")
        words, written = np.zeros((len(k), exprs.word_count(p.dim * levels)), np.int64), np.zeros(len(k), np.int64)
        for found, own in _by_tree(trees, shared, given):
            if found.levels != levels:
                raise ValueError("the codebook is of another width than the indices")
            words[own], written[own] = huffman.encode(k[own], found)
        return pa.StructArray.from_arrays([kernels.lists(words, given, pa.int64()), pa.array(written, mask=~given)], ["words", "written"])

    column = tree_literal(shared) if shared else F.col(tree)
    out = df.withColumn("_h", once(run)(F.col("idx"), column)).withColumn("_tree", column if embed else F.lit(None).cast(TREE)).drop("idx", *([tree] if isinstance(tree, str) else []))
    out = _blank(out, "huffman", p).withColumns({"payload_words": F.col("_h.words"), "written_bits": F.col("_h.written"), "valid_bits": F.lit(p.dim * levels).cast("long"), "tree": F.col("_tree")})
    return _ordered(_stamped(out.drop("_h", "_tree"), "arrow"))


def _by_tree(trees: pa.Array, shared: huffman.Tree | None, given: np.ndarray):
    """(tree, its rows): rows with equal trees together."""
    if shared is not None:
        yield shared, np.flatnonzero(given)
        return
    trees = trees.combine_chunks() if isinstance(trees, pa.ChunkedArray) else trees
    rows = np.flatnonzero(given)
    if np.asarray(trees.is_null())[rows].any():
        raise ValueError("a Huffman packet without a codebook")
    own = trees.take(pa.array(rows))
    size = np.diff(np.asarray(own.field("parent").offsets))
    for n in np.unique(size):  # trees of one width at a time, told apart by their links
        some = np.flatnonzero(size == n)
        few = own.take(pa.array(some))
        links = np.stack([np.asarray(few.field(side).flatten()).reshape(-1, n) for side in ("parent", "left", "right")], 1).reshape(len(some), -1)
        keyed, of = np.unique(np.c_[links, np.asarray(few.field("root"))], axis=0, return_inverse=True)
        order = np.argsort(of.ravel(), kind="stable")
        for key, at in zip(keyed.tolist(), np.split(some[order], np.flatnonzero(np.diff(of.ravel()[order])) + 1), strict=True):
            yield huffman.Tree(tuple(key[:n]), tuple(key[n : 2 * n]), tuple(key[2 * n : 3 * n]), key[-1]), rows[at]


def with_status(packets: DataFrame, engine: str = "arrow") -> DataFrame:
    """Adds ``status``: ok, or the first check that the packet fails."""
    if engine == "native":
        return packets.withColumn("status", exprs.packet_status())
    # A function stands in a column of its own: planned inside a CASE, Spark may leave it there unevaluated.
    stamped = packets.withColumn("_crc", _crc_udf(packets)(F.col("payload_words"), F.coalesce("written_bits", "valid_bits")))
    return stamped.withColumn("status", exprs.packet_status(F.col("_crc"))).drop("_crc")


def decode(packets: DataFrame, p: QuantParams, tree: huffman.Tree | str | None = None, mode: str = "strict", engine: str = "arrow", experimental_huffman: bool = False) -> DataFrame:
    """Adds ``idx`` and ``status``. An external tree wins over an embedded one.

    Strict: a packet that fails a check ends the query where its indices are used. Audit: its ``idx`` is null.
    """
    if mode not in vectors.MODES:
        raise ValueError(f"mode must be one of {vectors.MODES}")
    df = packets if "status" in packets.columns else with_status(packets, engine)
    matches = (F.col("dim") == p.dim) & (F.col("bit_width") == p.mse_bits)
    df = df.withColumn("status", F.when((F.col("status") == "ok") & ~matches, "params_mismatch").otherwise(F.col("status")))
    xored = F.col("encoding") == "delta_xor"
    words = F.when((F.col("status") == "ok") & F.col("encoding").isin("bitpacked", "delta_xor"), F.col("payload_words"))
    if engine == "native":
        df = df.withColumn("_words", F.when(xored, exprs.undo_delta_xor(words)).otherwise(words))
        df = df.withColumn("_fixed", F.when(F.col("_words").isNotNull(), exprs.unpack(F.col("_words"), p.dim, p.mse_bits))).drop("_words")
    else:
        df = df.withColumn("_fixed", _unpack_udf(df, p)(words, F.coalesce(xored, F.lit(False))))
    df = df.withColumn("_coded", _huffman_decode(df, p, tree) if experimental_huffman else F.lit(None).cast("array<int>"))
    idx = F.coalesce("_fixed", "_coded")
    none = "undecodable" if experimental_huffman else "huffman_disabled"
    df = df.withColumn("idx", idx).drop("_fixed", "_coded")
    df = df.withColumn("status", F.when(F.col("status") != "ok", F.col("status")).when(F.col("idx").isNull(), none).otherwise("ok"))
    if mode == "strict":
        df = df.withColumn("idx", F.coalesce("idx", F.raise_error(F.concat(F.lit("packet refused: "), F.col("status"))).cast("array<int>")))
    return df


def _unpack_udf(df: DataFrame, p: QuantParams):
    ship(df.sparkSession)

    @F.arrow_udf("array<int>")
    def run(words: pa.Array, xored: pa.Array) -> pa.Array:
        w, given = kernels.matrix(words, exprs.word_count(p.dim * p.mse_bits), "int64")
        back = xored.to_numpy(zero_copy_only=False)
        w[back] = kernels.undo_delta_xor(w[back])
        return kernels.lists(kernels.unpack(w, p.dim, p.mse_bits), given, pa.int32())

    return once(run)


def _huffman_decode(df: DataFrame, p: QuantParams, tree: huffman.Tree | str | None) -> Column:
    """Symbols, or null where the bits end early or no tree is at hand."""
    ship(df.sparkSession)
    shared = tree if isinstance(tree, huffman.Tree) else None
    levels = 1 << p.mse_bits

    @F.arrow_udf("array<int>")
    def run(words: pa.Array, written: pa.Array, trees: pa.Array) -> pa.Array:
        given = ~np.asarray(words.is_null()) & (np.ones(len(words), bool) if shared else ~np.asarray(trees.is_null()))
        w, _ = kernels.matrix(words, exprs.word_count(p.dim * levels), "int64")
        out = np.full((len(w), p.dim), -1, np.int32)
        bits = written.fill_null(0).to_numpy(zero_copy_only=False)
        for found, own in _by_tree(trees, shared, given):
            if found.levels == levels:
                out[own] = huffman.decode(w[own], bits[own], p.dim, found)
        return kernels.lists(out, given & (out >= 0).all(1), pa.int32())

    ok = (F.col("status") == "ok") & (F.col("encoding") == "huffman") & (F.col("word_count") == exprs.word_count(p.dim * levels))
    trees = F.col(tree) if isinstance(tree, str) else F.col("tree")
    return once(run)(F.when(ok, F.col("payload_words")), F.coalesce("written_bits", "valid_bits"), trees)


def pipeline(df: DataFrame, p: QuantParams, emit_qjl: bool = True, entropy: bool = False, column: str = "embedding", engine: str = "native") -> DataFrame:
    """Vectors to packets in one plan: quantize, pack, and xor if ``entropy``; beside them qjl and residual_norm."""
    found = vectors.fused(df, p, emit_qjl, column, "arrow" if emit_qjl or engine == "arrow" else "native").drop("mse_rot", "mse_bits", "dim", "seed")
    packets = bitpack(found, p, engine)
    return delta_xor(packets, engine) if entropy else packets


def accounting(packets: DataFrame) -> DataFrame:
    """Adds wire_bytes, resident_bytes and codebook_bytes."""
    nodes = F.size("tree.parent")
    return packets.withColumns({
        "wire_bytes": exprs.wire_bytes(F.col("written_bits"), F.col("valid_bits")),
        "resident_bytes": exprs.resident_bytes(F.col("word_count"), F.when(F.col("tree").isNotNull(), nodes)),
        "codebook_bytes": F.when(F.col("encoding") == "huffman", exprs.codebook_bytes(F.col("bit_width"))),
    })
