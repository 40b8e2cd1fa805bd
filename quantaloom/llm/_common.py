"""What the operators of this subpackage share: tables, cut lineage, batches, numbering."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of a batch that Python code holds at once; texts are long, results short.
ROWS_AT_ONCE = 256


def ship(spark: SparkSession) -> None:
    """Gives the workers of this session the package, once, wherever they run."""
    context = spark.sparkContext
    if getattr(context, "_quantaloom_shipped", False):
        return
    root = Path(__file__).resolve().parents[2]
    if root.is_dir():  # else it came as an archive, and workers have that
        folder = os.path.realpath(tempfile.mkdtemp(prefix="quantaloom-ship-"))
        context.addPyFile(shutil.make_archive(f"{folder}/quantaloom", "zip", root, "quantaloom"))
    context._quantaloom_shipped = True


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``df.mapInArrow`` with workers that can import this package."""
    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a temporary one only in local mode."""
    if found := spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = tempfile.mkdtemp(prefix="quantaloom-")
    spark.conf.set("spark.checkpoint.dir", f"file://{made}")
    return f"file://{made}"


def cut(df: DataFrame) -> DataFrame:
    """The same rows, read from a table in the shared folder: nothing above is computed again when an executor is lost."""
    path = f"{shared_dir(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def slices(batches: Iterator[pa.RecordBatch], rows: int = ROWS_AT_ONCE) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a batch; null counts as empty."""
    return [x or "" for x in batch.column(column).to_pylist()]


def unused(df: DataFrame, name: str) -> str:
    """``name``, or one made from it, that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def numbered(df: DataFrame, groups: list[str], order: list[Column], spread: Column, name: str, rows_a_task: int = 50_000) -> DataFrame:
    """Adds ``name``: gapless numbers from 0 within each of ``groups``.

    A group of any size is dealt over many tasks: rows fall into buckets by ``spread``, the buckets are counted
    (a partial aggregation), each bucket starts where those before it end, and rows are numbered within a bucket.
    ``df`` is read twice, so it should be a written table.
    """
    buckets = max(8, -(-df.count() // rows_a_task))
    dealt = df.withColumn("_bucket", F.pmod(F.xxhash64(spread), F.lit(buckets)).cast("int"))
    keys = [*groups, "_bucket"]
    before = Window.partitionBy(*groups).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    starts = starts.select(*keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return dealt.withColumn("_rank", within).join(starts, keys).withColumn(name, (F.col("_start") + F.col("_rank") - 1).cast("long")).drop("_bucket", "_rank", "_start")
