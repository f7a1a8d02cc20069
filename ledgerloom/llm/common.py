"""Helpers that the corpus operators share."""

from __future__ import annotations

import re
import sys
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words, as a Java and Python pattern.
BLANKS = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Stands for a null doc_id in joins.
NO_ID = -(1 << 63)
#: A table of at most this many bytes may be broadcast.
BROADCAST_BYTES = 64 << 20
#: Spark's setting that removes the shuffle files of a query when it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def ships(module: str) -> None:
    """The module's functions travel to the executors with the job; those need no copy of this package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


ships(__name__)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(text: str | Column = "text") -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def keyed(docs: DataFrame, prefix: str = "") -> DataFrame:
    """With id0 and th, which know a row for joins: doc_id (``NO_ID`` for null) and a hash of the text. Rows equal in both are copies."""
    return docs.withColumns({f"{prefix}id0": F.coalesce("doc_id", F.lit(NO_ID)), f"{prefix}th": F.xxhash64(text_or_empty())})


def words(text: Column) -> Column:
    """The words between blanks; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANKS), "")


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, all else as it is; the fast path serves pure ASCII."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the folder that driver and executors share."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="spark-")  # one machine, as in tests
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a query that runs inside go when it ends, not when the driver next collects garbage."""
    was = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, was)


def stored(df: DataFrame, label: str) -> DataFrame:
    """Written once to the shared folder and read back: cuts the lineage, and survives lost executors."""
    path = scratch(df.sparkSession, label)
    with tidy(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """The intermediate tables of one job, by label, in the shared folder. What isn't kept goes when the job ends or fails."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def put(self, label: str, df: DataFrame) -> DataFrame:
        """Stores ``df``, then drops an earlier table of this label, which ``df`` may still have read."""
        path = scratch(self.spark, label)
        with tidy(self.spark):
            df.write.parquet(path)
        self.drop(label)
        self.paths[label] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def count(self, df: DataFrame) -> int:
        with tidy(self.spark):
            return df.count()

    def drop(self, *labels: str) -> None:
        for label in labels:
            if path := self.paths.pop(label, None):
                delete(self.spark, path)

    def keep(self, label: str) -> None:
        """The table outlives the job; its reader answers for it."""
        self.paths.pop(label)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self.drop(*list(self.paths))


def small(df: DataFrame, rows: int) -> DataFrame:
    """Marked for broadcast if it has at most ``rows`` rows; beyond that the join shuffles. df: a stored table."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def summed(parts: DataFrame, dtype: str, to: str | None = None) -> dict[int, bytes]:
    """parts: i int, b binary, arrays of ``dtype``. The arrays of each i added up in 64 bits, as ``to`` if given.

    Tasks stream their share of the parts, so any number of parts needs the memory of the result only;
    the result's size must be fixed by the caller.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, np.ndarray] = {}
        for pdf in batches:
            for i, b in zip(pdf["i"], pdf["b"]):
                got = np.frombuffer(b, dtype=dtype)
                if i in held:
                    held[i] += got
                else:
                    held[i] = got.astype(np.promote_types(got.dtype, "int64") if got.dtype.kind == "i" else got.dtype)
        for i, total in held.items():
            yield pd.DataFrame({"i": [i], "b": [total.astype(to or dtype).tobytes()]})

    with tidy(parts.sparkSession):
        rows = parts.repartition("i").mapInPandas(run, "i int, b binary").collect()
    return {r["i"]: bytes(r["b"]) for r in rows}
