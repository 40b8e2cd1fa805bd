"""Codebook reuse over streams of vectors, in batch: which tree each vector of a stream is coded with.

A stream's tree is built anew, from the current vector alone, for its first vector, when the width changes, after an
``invalidate``, and after every ``cadence`` vectors; a stream may begin with a given book, which is its generation 1. The
automatic policy measures the cadence on the first vector of each run of one shape (dim, width), and each run is a policy
of its own whose generations go on from the last: the saving of Huffman over fixed width must pay for the tree, within 1
to 256 vectors.

Rows: ``idx`` in the order of a column within a stream; of streams that change shape also ``dim`` and ``bit_width`` (of
the indices); ``control`` 'invalidate' marks rows that are no vectors but drop the stream's book. Streams are partitions of
a window; a stream's order makes its generations a running count, and one tree is built for each generation.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantaloom.functions import exprs, huffman
from quantaloom.functions.params import QuantParams
from quantaloom.operators import codecs
from quantaloom.sources.session import ship

MIN_CADENCE, MAX_CADENCE = 1, 256


def policy_id(stream: Column, segment: Column | None = None) -> Column:
    """A positive id that is the same in each run; another for each run of one shape of a stream."""
    return F.xxhash64(stream, *([segment] if segment is not None else [])).bitwiseAND(F.lit((1 << 62) - 1))


def segments(df: DataFrame, stream: str, order: str, shape: Sequence[str]) -> DataFrame:
    """Leaves out control rows; adds segment (runs of one shape without an invalidation, from 1), nth (of the segment's vectors, from 0)."""
    of_stream = Window.partitionBy(stream).orderBy(order)
    dropped = F.lit(0)
    if "control" in df.columns:
        drop = F.coalesce(F.col("control") == "invalidate", F.lit(False))
        dropped = F.sum(drop.cast("long")).over(of_stream.rowsBetween(Window.unboundedPreceding, 0))
        df = df.withColumn("_dropped", dropped).withColumn("_drop", drop).where("NOT _drop").drop("_drop", "control")
    else:
        df = df.withColumn("_dropped", dropped.cast("long"))
    now = F.struct("_dropped", *shape)
    before = F.lag(now).over(of_stream)
    df = df.withColumn("segment", F.sum(F.when(before.isNull() | ~before.eqNullSafe(now), 1).otherwise(0)).over(of_stream))
    return df.withColumn("nth", (F.row_number().over(Window.partitionBy(stream, "segment").orderBy(order)) - 1).cast("long"))


def _counted(df: DataFrame, cadence: int | Column, stream: str, order: str, given: Column, begun: Column) -> DataFrame:
    """Adds tokens, rebuilt, generation. ``given``: whether the row's segment begins with a book; ``begun``: whether its stream did."""
    of_stream = Window.partitionBy(stream).orderBy(order)
    df = df.withColumn("tokens", (F.col("nth") % cadence).cast("long")).withColumn("rebuilt", (F.col("tokens") == 0) & ~(given & (F.col("nth") == 0)))
    return df.withColumn("generation", F.sum(F.col("rebuilt").cast("long")).over(of_stream) + begun.cast("long"))


def reuse_epochs(df: DataFrame, cadence: int | Column, stream: str = "stream_key", order: str = "seq", width: str = "bit_width", initial: DataFrame | None = None) -> DataFrame:
    """Adds segment (runs of one width), tokens (vectors coded since the rebuild, this one not counted), rebuilt, generation.

    ``initial``: (stream, tree), the book that a stream begins with; adds it as initial_tree."""
    if isinstance(cadence, int) and cadence < 1:
        raise ValueError("cadence must be at least 1")
    given = begun = F.lit(False)
    if initial is not None:
        df = df.join(initial.select(stream, F.col("tree").alias("initial_tree")), stream, "left")
        begun = F.col("initial_tree").isNotNull()
        of_width = F.size("initial_tree.parent") == F.pow(F.lit(2), F.col(width) + 1)
        given = F.coalesce(begun & of_width & (F.col("segment") == 1) & (F.col("_dropped") == 0), F.lit(False))
    found = _counted(segments(df, stream, order, [width]), cadence, stream, order, given, begun)
    return found.drop("nth", "_dropped")


def _shaped(df: DataFrame, p: QuantParams | Sequence[QuantParams]) -> tuple[DataFrame, list[QuantParams]]:
    """The parameters; and the rows with their dim and bit_width, which rows of one shape need not have."""
    if isinstance(p, QuantParams):
        return df.withColumns({"dim": F.lit(p.dim), "bit_width": F.lit(p.mse_bits)}), [p]
    return df, list(p)


def encode_with_reuse(
    df: DataFrame, p: QuantParams | Sequence[QuantParams], cadence: int, stream: str = "stream_key", order: str = "seq", experimental_huffman: bool = False, initial: DataFrame | None = None
) -> DataFrame:
    """``idx`` of streams to Huffman packets, each with the tree of its generation's first vector, and that tree's tags.

    ``p``: parameters of all rows, or those of each shape (dim, bit_width) that rows have."""
    codecs.require_huffman(experimental_huffman)
    df, params = _shaped(df, p)
    return _coded(reuse_epochs(df, cadence, stream, order, initial=initial), params, None, stream, order).drop("segment")


def _with_books(epochs: DataFrame, segment: Column | None, stream: str, order: str) -> DataFrame:
    """Adds _book and _tag of each row's generation, and _policy. A tree is built where its generation begins, and carried on."""
    so_far = Window.partitionBy(stream).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    df = epochs.withColumn("_policy", policy_id(F.col(stream), segment))
    df = df.withColumn("_new", codecs.trees(df, F.when(F.col("rebuilt"), F.col("idx")), F.col("bit_width")))
    if "initial_tree" in df.columns:
        # A generation begins with the given book where none was built for its first vector.
        begins = (F.col("generation") == 1) & (F.col("tokens") == 0) & ~F.col("rebuilt")
        df = df.withColumn("_new", F.when(begins, F.col("initial_tree")).otherwise(F.col("_new"))).drop("initial_tree")
    df = df.withColumn("_new", F.struct(F.col("_new").alias("tree"), _fingerprint_udf(df)(F.col("_new"), F.col("bit_width"), F.col("generation"), F.col("_policy")).alias("tag")))
    df = df.withColumn("_new", F.when(F.col("_new.tree").isNotNull(), F.col("_new")))
    df = df.withColumn("_now", F.last("_new", ignorenulls=True).over(so_far))
    return df.withColumns({"_book": F.col("_now.tree"), "_tag": F.col("_now.tag")}).drop("_now")


def _coded(epochs: DataFrame, params: list[QuantParams], segment: Column | None, stream: str, order: str) -> DataFrame:
    df, out = _with_books(epochs, segment, stream, order).drop("_new").withColumnRenamed("generation", "_gen"), None
    shape = F.struct("dim", "bit_width")
    known = [F.struct(F.lit(p.dim).alias("dim"), F.lit(p.mse_bits).alias("bit_width")) for p in params]
    for p, one in zip(params, known, strict=True):
        own = F.when(shape.isin(*known), shape == one).otherwise(F.raise_error(F.lit("a row of a shape without parameters")).cast("boolean"))
        part = codecs.huffman_encode(df if len(params) == 1 else df.where(own), p, "_book", True)
        out = part if out is None else out.unionByName(part)
    return out.withColumns({"policy_id": F.col("_policy"), "codebook_generation": F.col("_gen"), "codebook_fingerprint": F.col("_tag")}).drop("_policy", "_gen", "_tag")


def _fingerprint_udf(df: DataFrame):
    ship(df.sparkSession)

    @F.arrow_udf("string")
    def run(trees: pa.Array, bits: pa.Array, generations: pa.Array, policies: pa.Array) -> pa.Array:
        rows = zip(trees.to_pylist(), bits.to_pylist(), generations.to_pylist(), policies.to_pylist(), strict=True)
        return pa.array([t and huffman.fingerprint(codecs.tree_of(t), b, g, i) for t, b, g, i in rows], pa.string())

    return codecs.once(run)


def _registered(epochs: DataFrame, segment: Column | None, stream: str, order: str) -> DataFrame:
    books = _with_books(epochs, segment, stream, order).where(F.col("_new").isNotNull())
    return books.select(F.col("_policy").alias("policy_id"), "generation", F.col("_new.tree").alias("tree"), F.col("_new.tag").alias("fingerprint"))


def registry(df: DataFrame, p: QuantParams | Sequence[QuantParams], cadence: int, stream: str = "stream_key", order: str = "seq", initial: DataFrame | None = None) -> DataFrame:
    """(policy_id, generation, tree, fingerprint): the books of streams, from the vectors that they were built from."""
    return _registered(reuse_epochs(_shaped(df, p)[0], cadence, stream, order, initial=initial), None, stream, order)


def policy_status(packets: DataFrame, books: DataFrame, active: DataFrame | None = None) -> DataFrame:
    """Adds status and book_tree. Checked in this order: policy_id, generation, fingerprint, then the packet's own checks.

    ``books``: (policy_id, generation, tree, fingerprint). ``active``: (policy_id, generation) of the book in use; a packet
    of an older generation is refused. Packets of fixed width skip the policy's checks. Invalidating a policy is leaving its
    rows out of ``books``: its id and its generations go on.
    """
    found = books.select(F.col("policy_id").alias("_p"), F.col("generation").alias("_g"), F.col("tree").alias("book_tree"), F.col("fingerprint").alias("_f"))
    known = books.select(F.col("policy_id").alias("_known")).distinct()
    if active is not None:
        now = active.select(F.col("policy_id").alias("_known"), F.col("generation").alias("_now"))
        known = known.join(now, "_known", "left")
    df = codecs.with_status(packets, "arrow")
    df = df.join(known, df["policy_id"] == known["_known"], "left")
    df = df.join(found, (df["policy_id"] == found["_p"]) & (df["codebook_generation"] == found["_g"]), "left")
    stale = F.lit(False) if active is None else ~F.coalesce(F.col("codebook_generation") == F.col("_now"), F.lit(False))
    huff = F.col("encoding") == "huffman"
    wrong = ~F.coalesce(F.col("codebook_fingerprint") == F.col("_f"), F.lit(False))
    status = F.when(huff & F.col("_known").isNull(), "policy_id").when(huff & (F.col("_p").isNull() | stale), "generation").when(huff & wrong, "fingerprint").otherwise(F.col("status"))
    return df.withColumn("status", status).drop("_p", "_g", "_f", "_known", "_now")


def decode_with_policy(packets: DataFrame, books: DataFrame, p: QuantParams, mode: str = "strict", active: DataFrame | None = None) -> DataFrame:
    return codecs.decode(policy_status(packets, books, active), p, "book_tree", mode, experimental_huffman=True).drop("book_tree")


def _measured(df: DataFrame, idx: Column) -> DataFrame:
    """Adds fixed_bytes, huffman_bytes, saved and cadence from ``idx`` of rows with dim and bit_width; null where ``idx`` is."""
    df = df.withColumns({"fixed_bytes": exprs.bits_to_bytes(F.col("dim") * F.col("bit_width")), "huffman_bytes": exprs.bits_to_bytes(codecs.coded_bits(df, idx, F.col("bit_width")))})
    df = df.withColumn("saved", F.greatest(F.lit(0).cast("long"), F.col("fixed_bytes") - F.col("huffman_bytes")))
    pays = F.ceil(exprs.codebook_bytes(F.col("bit_width")) / F.col("saved"))
    cadence = F.when(F.col("saved") == 0, MIN_CADENCE).otherwise(F.greatest(F.lit(MIN_CADENCE), F.least(F.lit(MAX_CADENCE), pays)))
    return df.withColumn("cadence", F.when(F.col("huffman_bytes").isNotNull(), cadence).cast("int"))


def auto_cadence(df: DataFrame, p: QuantParams) -> DataFrame:
    """Adds fixed_bytes, huffman_bytes (with the row's own tree), saved and cadence."""
    return _measured(_shaped(df, p)[0], F.col("idx")).drop("dim", "bit_width")


def auto_epochs(df: DataFrame, p: QuantParams | Sequence[QuantParams], stream: str = "stream_key", order: str = "seq") -> DataFrame:
    """Adds segment, cadence (measured on the segment's first vector), tokens, rebuilt and generation."""
    df = segments(_shaped(df, p)[0], stream, order, ["dim", "bit_width"])
    df = _measured(df, F.when(F.col("nth") == 0, F.col("idx"))).drop("fixed_bytes", "huffman_bytes", "saved")
    first = Window.partitionBy(stream, "segment").orderBy(order)
    df = df.withColumn("cadence", F.first("cadence").over(first))
    return _counted(df, F.col("cadence"), stream, order, F.lit(False), F.lit(False)).drop("nth", "_dropped")


def encode_auto(df: DataFrame, p: QuantParams | Sequence[QuantParams], stream: str = "stream_key", order: str = "seq", experimental_huffman: bool = False) -> DataFrame:
    """As ``encode_with_reuse``, with the cadence measured anew at each change of shape and after each invalidation, where a
    policy with an id of its own begins; adds cadence."""
    codecs.require_huffman(experimental_huffman)
    return _coded(auto_epochs(df, p, stream, order), _shaped(df, p)[1], F.col("segment"), stream, order).drop("segment")


def registry_auto(df: DataFrame, p: QuantParams | Sequence[QuantParams], stream: str = "stream_key", order: str = "seq") -> DataFrame:
    """The books of ``encode_auto``."""
    return _registered(auto_epochs(df, p, stream, order), F.col("segment"), stream, order)
