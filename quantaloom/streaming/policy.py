"""The codebook-reuse policy over a stream: one state for each stream key, fed in the order of ``seq``.

Rows: stream_key, seq, idx, and optionally bit_width (of the indices; a change of it rebuilds) and control ('invalidate'
drops the book and keeps the generation). A micro-batch is sorted by seq within its key, so a key's rows of one batch
must fit in a worker; a row that comes in a later batch is later, whatever its seq.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantaloom.functions import huffman
from quantaloom.functions.params import QuantParams
from quantaloom.operators.codecs import require_huffman
from quantaloom.sources.session import ship

OUTPUT = "stream_key long, seq long, tokens long, rebuilt boolean, generation long, written_bits long"
#: The book in use as the length of each symbol's code; none after an invalidation.
STATE = "tokens long, generation long, lengths array<long>"


def _lengths(tree: huffman.Tree) -> list[int]:
    return [len(c) for c in huffman.codes(tree)]


def reuse_stream(df: DataFrame, p: QuantParams, cadence: int, experimental_huffman: bool = False, initial: huffman.Tree | None = None) -> DataFrame:
    """A row for each vector: tokens since the rebuild before it, whether it rebuilt, the generation, and its coded bits.

    ``initial``: the book that each stream begins with, as its generation 1."""
    require_huffman(experimental_huffman)
    if cadence < 1:
        raise ValueError("cadence must be at least 1")
    ship(df.sparkSession)
    begin = (0, 0, None) if initial is None else (0, 1, _lengths(initial))
    for name, default in (("control", F.lit(None).cast("string")), ("bit_width", F.lit(p.mse_bits))):
        if name not in df.columns:
            df = df.withColumn(name, default)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        tokens, generation, lengths = state.get if state.exists else begin
        size = None if lengths is None else np.array(lengths)
        rows = pd.concat(list(batches)).sort_values("seq", kind="stable")
        out = []
        for seq, idx, bits, control in zip(rows["seq"], rows["idx"], rows["bit_width"], rows["control"], strict=True):
            if control == "invalidate":
                tokens, size = 0, None
                continue
            symbols, levels = np.asarray(idx), 1 << int(bits)
            rebuilt = size is None or len(size) != levels or tokens >= cadence
            if rebuilt:
                size, tokens, generation = np.array(_lengths(huffman.build_tree(huffman.symbol_counts(symbols, levels)))), 0, generation + 1
            out.append((key[0], int(seq), tokens, rebuilt, generation, int(size[symbols].sum())))
            tokens += 1
        state.update((tokens, generation, None if size is None else size.tolist()))
        yield pd.DataFrame(out, columns=["stream_key", "seq", "tokens", "rebuilt", "generation", "written_bits"])

    return df.select("stream_key", "seq", "idx", "bit_width", "control").groupBy("stream_key").applyInPandasWithState(run, OUTPUT, STATE, "append", "NoTimeout")


def paged(df: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Extension: packets with paging columns (sequence_id, layer_id, page_id, page_version, ts), each version of a page once,
    even if sent again up to ``late`` afterwards."""
    return df.withWatermark("ts", late).dropDuplicatesWithinWatermark(["sequence_id", "layer_id", "page_id", "page_version"])
