"""Line deduplication with levelled sorted runs of line hashes.

Every line key that has been seen is kept in runs: tables bucketed and sorted by hash, one file a bucket. A
batch's keys are dealt and sorted in the same way and merge-joined with the runs, which are neither shuffled
nor sorted again; its new keys (those the join finds in no run) become a run of level 0. When a level holds
``fanout`` runs, they are merged into one run of the next level, so a key is rewritten about log(batches) times.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce
from operator import or_

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, ships, text_or_empty, tidy

ships(__name__)

MIN_CHARS = 10
_STRIP = " \t\n\x0b\x0c\r"
_LOWER = {c: c + 32 for c in range(65, 91)}
KEY = ["h1", "h2"]


def line_key(line: str) -> str:
    """Blanks stripped at both ends, A-Z in lower case."""
    return line.strip(_STRIP).translate(_LOWER)


def key_hash(line: str, min_chars: int = MIN_CHARS) -> bytes | None:
    """128 bits of the key; None for a key of under ``min_chars`` code points, which always stays."""
    bare = line.strip(_STRIP)
    if len(bare) < min_chars:
        return None
    return xxhash.xxh3_128_digest((bare.lower() if bare.isascii() else bare.translate(_LOWER)).encode("utf-8", "surrogatepass"))


def line_hashes(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, h1, h2: one row for each key of each document's whole text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids, digests = [], []
            for doc, text in zip(pdf["doc_id"], pdf["text"]):
                keys = {h for line in set(text.split("\n")) if (h := key_hash(line, min_chars))}
                ids += [doc] * len(keys)
                digests += keys
            h1 = [int.from_bytes(h[:8], "little", signed=True) for h in digests]
            h2 = [int.from_bytes(h[8:], "little", signed=True) for h in digests]
            yield pd.DataFrame({"doc_id": pd.array(ids, "Int64"), "h1": h1, "h2": h2})

    return docs.select("doc_id", text_or_empty().alias("text")).mapInPandas(run, "doc_id long, h1 long, h2 long")


@contextmanager
def _in_order(spark: SparkSession) -> Iterator[None]:
    """Inside, Spark trusts that a bucket of one file is sorted as it was written."""
    name = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    was = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, was)


class LineRuns:
    """The levelled runs. State is the list of tables; each is written once and never changed. Used in a ``with``, they go at its end."""

    def __init__(self, spark: SparkSession, buckets: int | None = None, fanout: int = 2):
        self.spark, self.fanout = spark, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = [[]]
        self.scratch = Scratch(spark)

    def __enter__(self) -> LineRuns:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def _write(self, keys: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        with tidy(self.spark):
            keys.repartition(self.buckets, *KEY).write.bucketBy(self.buckets, *KEY).sortBy(*KEY).saveAsTable(name)
        return name

    def tables(self) -> list[DataFrame]:
        return [self.spark.table(t) for level in self.levels for t in level]

    def marked(self, batch: DataFrame) -> DataFrame:
        """A row for each of the batch's keys: h1, h2, owner and last (the smallest and largest doc_id), and old (a run holds it)."""
        out, flags = batch.groupBy(*KEY).agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last")), []
        for i, run in enumerate(self.tables()):
            flags.append(F.col(f"in{i}").isNotNull())
            out = out.join(run.withColumn(f"in{i}", F.lit(True)), KEY, "left")
        return out.select(*KEY, "owner", "last", reduce(or_, flags, F.lit(False)).alias("old"))

    def add(self, batch: DataFrame, label: str = "drops") -> DataFrame:
        """batch: doc_id, h1, h2. Returns the pairs that repeat an earlier line, stored; their keys and all new ones are then held.

        In a batch the smallest doc_id holds a line; between batches the earlier one.
        """
        with _in_order(self.spark):
            state = self.scratch.put("state", self.marked(batch))
        # (h1, h2, owner or null if an earlier batch holds the line): only keys with lines to drop
        held = self.scratch.put("held", state.where("old OR owner < last").select(*KEY, F.when(~F.col("old"), F.col("owner")).alias("owner")))
        drop = self.scratch.put(label, batch.join(held, KEY).where("owner IS NULL OR doc_id > owner").select("doc_id", *KEY))
        self.levels[0].append(self._write(state.where("NOT old").select(*KEY)))
        self._compact()
        return drop

    def _compact(self) -> None:
        for i in range(64):
            if i >= len(self.levels) or len(self.levels[i]) < self.fanout:
                return
            merged = self._write(reduce(DataFrame.unionByName, [self.spark.table(t) for t in self.levels[i]]))
            if i + 1 == len(self.levels):
                self.levels.append([])
            self.levels[i + 1].append(merged)
            for t in self.levels[i]:
                self.spark.sql(f"DROP TABLE {t}")
            self.levels[i] = []

    def close(self) -> None:
        for level in self.levels:
            for t in level:
                self.spark.sql(f"DROP TABLE {t}")
        self.levels = [[]]
        self.scratch.drop(*list(self.scratch.paths))


def without_lines(docs: DataFrame, drops: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """docs' columns with text cut, then n_lines, n_dropped and kept_sha256. drops: doc_id, h1, h2."""
    per_doc = drops.groupBy("doc_id").agg(F.collect_list(F.struct(*KEY)).alias("__drop"))
    own = ("n_lines", "n_dropped", "kept_sha256", "__drop")
    base = docs.drop(*(c for c in own if c in docs.columns)).withColumn("text", text_or_empty())
    both = base.join(per_doc, "doc_id", "left").withColumn("__drop", F.transform("__drop", lambda x: F.concat(F.hex(x["h1"]), F.lit("/"), F.hex(x["h2"]))))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts, lines, dropped, shas = [], [], [], []
            for text, drop in zip(pdf["text"], pdf["__drop"]):
                parts = text.split("\n")
                kept = parts
                if drop is not None and len(drop):
                    gone = set(drop)
                    kept = [x for x in parts if (h := key_hash(x, min_chars)) is None or _shown(h) not in gone]
                    text = "\n".join(kept)
                texts.append(text)
                lines.append(len(parts))
                dropped.append(len(parts) - len(kept))
                shas.append(hashlib.sha256(text.encode()).hexdigest())
            yield pdf.drop(columns="__drop").assign(text=texts, n_lines=lines, n_dropped=dropped, kept_sha256=shas)

    return both.mapInPandas(run, f"{fields}, n_lines long, n_dropped long, kept_sha256 string")


def _shown(h: bytes) -> str:
    return re.sub("^0+(?=.)", "", h[7::-1].hex().upper()) + "/" + re.sub("^0+(?=.)", "", h[:7:-1].hex().upper())


def dedup(docs: DataFrame, batches: int = 4, min_chars: int = MIN_CHARS) -> DataFrame:
    """Feeds ``docs`` to new runs in ``batches`` ranges of doc_id, lowest first, and cuts the texts."""
    spark = docs.sparkSession
    with Scratch(spark) as scratch, LineRuns(spark) as runs:
        keys = scratch.put("line-keys", line_hashes(docs, min_chars))
        low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
        drops = [keys.where("false")]
        if low is not None:
            step = (high - low) // batches + 1
            for i in range(batches):
                start = low + i * step
                drops.append(runs.add(keys.where((F.col("doc_id") >= start) & (F.col("doc_id") < start + step)), f"drops-{i}"))
        all_drops = scratch.put("all-drops", reduce(DataFrame.unionByName, drops))
        scratch.keep("all-drops")
    return without_lines(docs, all_drops, min_chars)


def op3_line_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 for every document.

    Null and empty texts are one empty line. Rows that share a doc_id count as one document and lose
    the same lines; rows with a null doc_id hold no line and lose none. An empty table gives no rows.
    """
    return dedup(docs.select("doc_id", "text")).select("doc_id", "n_lines", "n_dropped", "kept_sha256")


ORACLE = """
WITH l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM l),
o AS (SELECT k, min(doc_id) AS owner FROM k WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) > 1),
f AS (SELECT k.*, coalesce(owner <> doc_id, false) AS gone FROM k LEFT JOIN o USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM f GROUP BY doc_id
"""
