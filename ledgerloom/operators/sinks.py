"""Statutory and ERP files as columns of text lines; every line is one row, so files of any size are written in parallel. Intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Spark's setting that removes the shuffle files of a query when it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


# K07
def operation_pairs(rows: DataFrame) -> DataFrame:
    """Debit and credit of each operation line side by side; incomplete pairs are skipped."""
    side = lambda d, c: F.max(F.when(F.col("direction") == d, F.col(c)))
    out = rows.groupBy("invoice_id", "line").agg(side("D", "account").alias("debit_account"), side("K", "account").alias("credit_account"), side("D", "amount").alias("amount"))
    return out.where("debit_account IS NOT NULL AND credit_account IS NOT NULL")



def write_lines(lines: DataFrame, path: str, by: tuple[str, ...] = ()) -> None:
    """Text in cp1251 with CRLF: a CSV of one column without quoting, since the text writer knows UTF-8 only. by: columns that name folders."""
    spark = lines.sparkSession
    before = spark.conf.get("spark.sql.legacy.javaCharsets", "false")
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")  # read when the write is planned
    try:
        out = lines.select(*by, "line").write.option("encoding", "windows-1251").option("lineSep", "\r\n").option("quote", "").option("escape", "").option("sep", "\u0001").option("ignoreTrailingWhiteSpace", False).option("ignoreLeadingWhiteSpace", False)
        (out.partitionBy(*by) if by else out).csv(path)
    finally:
        spark.conf.set("spark.sql.legacy.javaCharsets", before)


def stored(df: DataFrame, label: str) -> DataFrame:
    """Written once as Parquet to the folder in ``spark.checkpoint.dir`` and read back, so that what reads it several times doesn't make it again.

    Only where that is unset and the master is ``local``, as in tests, a temporary folder serves. Shuffle files of the job go when it ends."""
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", root)
    path, was = f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}", spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, was)
    return spark.read.schema(df.schema).parquet(path)
