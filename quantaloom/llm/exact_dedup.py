"""Exact dedup: a persistent digest index, bucketed and sorted by digest; new rows meet it in a sort-merge anti-join.

Documents are added in parts by rising doc_id: each part's distinct digests are anti-joined with the index, and what is new
is appended with the part's smallest doc_id, which so is the smallest of all.

Defined results: a null text counts as empty; empty texts are equal to each other; texts are read whole, and only their
digests are shuffled. Of equal texts the row with the smallest doc_id stays, a null doc_id sorts after all others, and of rows
equal in doc_id and text exactly one stays. A batch that is added again under its name (after a lost driver) gives the rows that
it gave before. An empty table gives no rows. Columns other than doc_id and text are not looked at, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from quantaloom.llm._common import cut, table, unused


def normalised(text: Column) -> Column:
    """Runs of ASCII white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def digest_of(text: Column) -> Column:
    return F.sha2(normalised(text), 256)


class DigestIndex:
    """Digests seen so far and the row that stays for each, as a table (digest, keep_id, batch) bucketed and sorted by digest.

    The bucketed layout lets each later batch be anti-joined without shuffling the index: only the batch's
    distinct digests move. A digest table holds 32 bytes and an id a text, never the texts. With ``path``, a folder that the
    driver and all executors share, the table lies there and a session with another catalog finds it again; without, it is a
    table of the warehouse. An index that is there keeps its number of buckets, whatever the session's settings.
    """

    def __init__(self, spark: SparkSession, name: str, buckets: int | None = None, path: str | None = None) -> None:
        self.spark, self.name, self.path = spark, name, path
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        if self.exists():
            rows = spark.sql(f"DESCRIBE EXTENDED {name}").where("col_name = 'Num Buckets'").collect()
            self.buckets = int(rows[0]["data_type"])
        elif path is not None and (found := self._spec()):
            self.buckets = found["buckets"]
            self._create(found["kind"])

    def _spec(self):
        try:
            return self.spark.read.schema("buckets int, kind string").parquet(f"{self.path}/spec").first()
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def exists(self) -> bool:
        return self.spark.catalog.tableExists(self.name)

    def _create(self, kind: str) -> None:
        """``kind``: the type of doc_id."""
        place = "" if self.path is None else f" LOCATION '{self.path}/rows'"
        self.spark.sql(f"CREATE TABLE {self.name} (digest STRING, keep_id {kind}, batch STRING) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS{place}")
        if self.path is not None and self._spec() is None:
            self.spark.createDataFrame([(self.buckets, kind)], "buckets int, kind string").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/spec")

    def drop(self) -> None:
        """Forgets the table; what lies under ``path`` stays. What ``add`` returned stays good: it reads tables of its own."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def _append(self, rows: DataFrame) -> None:
        out = rows.select("digest", "keep_id", "batch").repartition(self.buckets, "digest")
        out.write.format("parquet").mode("append").bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.name, **({} if self.path is None else {"path": f"{self.path}/rows"}))
        self.spark.catalog.refreshTable(self.name)

    def _rows(self) -> DataFrame:
        return self.spark.table(self.name).hint("merge")

    def add(self, docs: DataFrame, batch: str, parts: int = 2) -> DataFrame:
        """Dedupes ``docs`` against all earlier batches and itself, appends what is new, and returns a row per document.

        doc_id, uid (this call's row), keep_id, group_size (equal rows of this batch), kept, text_sha256. ``batch``: a name
        of the caller's; one added before gives the same rows again. Ids that are no numbers go in one part.
        """
        if not self.exists():
            self._create(docs.schema["doc_id"].dataType.simpleString())
        rows = cut(docs.select("doc_id", digest_of(F.col("text")).alias("digest")).withColumn("uid", F.monotonically_increasing_id()))
        first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("keep_id"), F.col("uid").alias("keep_uid")))
        groups = None
        for part in _parts(rows, parts):
            own = part.groupBy("digest").agg(first.alias("first"), F.count(F.lit(1)).alias("n"))
            own = cut(own.select("digest", "first.no_id", "first.keep_id", "first.keep_uid", "n"))
            self._append(own.join(self._rows().select("digest"), "digest", "left_anti").withColumn("batch", F.lit(batch)))
            groups = own if groups is None else groups.unionByName(own)
        groups = groups.groupBy("digest").agg(F.min(F.struct("no_id", "keep_id", "keep_uid")).alias("first"), F.sum("n").alias("group_size"))
        index = self._rows().select("digest", "keep_id", (F.col("batch") == F.lit(batch)).alias("new"))
        stays = cut(groups.join(index, "digest").select("digest", "keep_id", "group_size", F.when(F.col("new"), F.col("first.keep_uid")).alias("keep_uid")))
        kept = F.coalesce(F.col("uid") == F.col("keep_uid"), F.lit(False))
        return rows.join(stays, "digest").select("doc_id", "uid", "keep_id", "group_size", kept.alias("kept"), F.col("digest").alias("text_sha256"))


def _parts(rows: DataFrame, parts: int) -> list[DataFrame]:
    """``rows`` by rising doc_id, null ones last; about equally many in each."""
    if parts < 2 or not isinstance(rows.schema["doc_id"].dataType, NumericType):
        return [rows]
    marks = rows.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)]).alias("m")).first()["m"]
    marks = sorted(set(marks or []))
    low = [F.lit(True), *(F.col("doc_id") > m for m in marks)]
    high = [*(F.col("doc_id") <= m for m in marks), F.lit(True)]
    out = [rows.where(a & b) for a, b in zip(low, high, strict=True)]
    return [*out[:-1], rows.where(low[-1] | F.col("doc_id").isNull())]


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that stay: of equal texts the one with the smallest doc_id."""
    spark = docs.sparkSession
    index = DigestIndex(spark, f"digest_index_{uuid.uuid4().hex}")
    stay = cut(index.add(docs.select("doc_id", "text"), "all").where("kept").select(F.col("doc_id").alias("id"), F.col("text_sha256").alias("sha")))
    index.drop()
    digest = unused(docs, "digest")
    keyed = docs.withColumn(digest, digest_of(F.col("text")))

    def same(other: DataFrame):
        return keyed["doc_id"].eqNullSafe(other["id"]) & (keyed[digest] == other["sha"])

    left = keyed.join(stay, same(stay), "left_semi")
    twice = keyed.groupBy("doc_id", digest).count().where("count > 1")
    if twice.isEmpty():
        return left.drop(digest)
    # Rows equal in doc_id and text: only these are dealt by key to leave one of each.
    twice = cut(twice.select(F.col("doc_id").alias("id"), F.col(digest).alias("sha")))
    once = left.join(twice, same(twice), "left_anti")
    return once.unionByName(left.join(twice, same(twice), "left_semi").dropDuplicates(["doc_id", digest])).drop(digest)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = DigestIndex(spark, f"digest_index_{uuid.uuid4().hex}")
    found = index.add(table(spark, sf_dir, "documents"), "all").select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    index.drop()  # a query keeps no index; a pipeline that adds batches does
    return found


QUERIES = {"op7_exact_dedup": op7_exact_dedup}

ORACLE = {
    "op7_exact_dedup": r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)"""
}
