"""Where vectors come from: Parquet, any DataFrame, or a seeded synthetic table; and where packets go."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quantaloom.sources.session import ship


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """vec_id, embedding (and what else the file has); columns that a query doesn't use aren't read."""
    return spark.read.parquet(path)


def synthetic_vectors(spark: SparkSession, rows: int, dim: int, seed: int = 0, low: float = -1.0, high: float = 1.0, partitions: int | None = None) -> DataFrame:
    """vec_id, embedding: coordinates uniform in [low, high). A row depends on its id and the seed only, not on partitions."""
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id").to_numpy()
            values = np.concatenate([np.random.default_rng([seed, i]).uniform(low, high, dim) for i in ids] or [np.empty(0)]).astype(np.float32)
            ends = pa.array(np.arange(len(ids) + 1, dtype=np.int32) * dim)
            yield pa.record_batch([batch.column("id"), pa.ListArray.from_arrays(ends, pa.array(values))], names=["vec_id", "embedding"])

    return spark.range(0, rows, 1, partitions).mapInArrow(run, "vec_id long, embedding array<float>")


def write_packets(packets: DataFrame, path: str, mode: str = "errorifexists") -> None:
    packets.write.mode(mode).parquet(path)


def read_packets(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
